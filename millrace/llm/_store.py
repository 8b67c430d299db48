"""Intermediate tables in the shared folder, size-checked broadcasts and table reading."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, NumericType, StringType, StructType

LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def work_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where it is unset, a local master has a local folder, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
    return root.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{work_root(spark)}/millrace/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_folders(spark: SparkSession) -> int:
    """Removes every folder that this process has made here, once no result that reads them is needed; how many."""
    n, conf = 0, spark._jsc.hadoopConfiguration()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_ROWS = 1_000_000
MOST_BYTES = 96 << 20


def _width(name: str, kind: DataType) -> Column:
    """Bytes of a column's value, about."""
    column = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(column), F.lit(0)) * (8 if isinstance(kind.elementType, NumericType) else 64) + 16
    return F.lit(64 if isinstance(kind, StructType) else 8)


def small_side(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most these rows and bytes (both counted), else unchanged, for a shuffled join. df should be a saved table."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    n, size = df.select(width.alias("w")).limit(most_rows + 1).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if n <= most_rows and (size or 0) <= most_bytes else df


def in_tasks(files: DataFrame, most: int = 10_000) -> DataFrame:
    """A small saved table of files, dealt to a task for each file; the number is given, as adaptive execution would put all of them into one task."""
    return files.repartitionByRange(max(1, min(most, files.count())), "path")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
