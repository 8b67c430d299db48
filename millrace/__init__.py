"""millrace: warehouse-style analytics expressed as Spark DataFrame and SQL operations."""
