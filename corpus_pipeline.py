"""The corpus pipeline: documents through quality rules, near-duplicate removal, benchmark decontamination, mixing and sharding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a stage
returns as a Parquet table in the shared folder and reads it again for the next. Columns of documents, of any name, come
through every stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, mixing, near_duplicates, quality_rules, sharding
from millrace.llm._store import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines above their host's limit are gone from those that stay. Null, empty and short texts fail the base rules; rows that repeat stay or go together."""
    return quality_rules.clean(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, the one with the smallest id, then the smallest text.

    Texts without words all stay, and so do unrelated texts under one id or none; of rows that repeat one stays.
    """
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts, and items of fewer than five tokens, overlap with nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a shard in one partition and in shuffled order; null and blank texts have no words and are never taken."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as read back from compacted shards, with shard_file, shard_bytes and shard_version, which replace columns of these names; no row is lost or added."""
    return sharding.sharded(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicate_removal), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Components of a graph and seeded draws have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
