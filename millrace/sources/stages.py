"""Stages and COPY INTO."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..warehouse import Warehouse, WarehouseError

FORMATS = ("csv", "json", "parquet", "orc")


def create_stage(warehouse: Warehouse, name: str, url: str, or_replace: bool = True) -> None:
    if name in warehouse.stages and not or_replace:
        raise WarehouseError(f"stage {name} is there already")
    warehouse.stages[name] = url.rstrip("/")


def drop_stage(warehouse: Warehouse, name: str, if_exists: bool = False) -> None:
    if warehouse.stages.pop(name, None) is None and not if_exists:
        raise WarehouseError(f"no stage {name}")


def copy_into(warehouse: Warehouse, table: str, stage: str, file: str = "", file_format: str = "csv", skip_header: int = 0, delimiter: str = ",") -> dict[str, int]:
    """Appends the rows of a stage's files (all, or one) to a table, columns in the table's order; rows_loaded and files_loaded.

    Files are read by Spark's readers with the table's schema. skip_header leaves out the first lines of each CSV file.
    """
    if stage not in warehouse.stages:
        raise WarehouseError(f"no stage {stage}")
    if file_format.lower() not in FORMATS:
        raise WarehouseError(f"unknown format {file_format}")
    target, kind = warehouse.table(table), file_format.lower()
    path = f"{warehouse.stages[stage]}/{file}" if file else warehouse.stages[stage]
    reader = warehouse.spark.read.option("pathGlobFilter", f"*.{kind}")
    if kind == "csv":
        reader = reader.option("sep", delimiter).option("header", skip_header == 1).option("enforceSchema", True).option("mode", "FAILFAST")
    try:
        if kind == "csv" and skip_header > 1:
            # lines by their place in the file: files are read whole, one line each row, and numbered by position
            lines = warehouse.spark.read.option("pathGlobFilter", "*.csv").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
            lines = lines.where((F.col("n") >= skip_header) & (F.col("line") != ""))
            parsed = lines.select("f", F.from_csv("line", target.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": delimiter, "mode": "FAILFAST"}).alias("r"))
            rows, files = parsed.select("r.*"), parsed.select("f")
        else:
            read = reader.schema(target.schema).format(kind).load(path)
            rows, files = read.select(*target.columns), read.select(F.col("_metadata.file_path").alias("f"))
        n_files = files.distinct().count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise WarehouseError(f"no files at {path}") from e
        raise
    if not n_files:
        raise WarehouseError(f"no files at {path}")
    return {"rows_loaded": warehouse.insert(table, rows), "files_loaded": n_files}
