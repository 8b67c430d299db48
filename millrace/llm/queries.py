"""The queries of the ten operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _training, decontamination, line_dedup, mixing, near_duplicates, quality, quality_rules, sharding, token_files, toxicity, warc
from ._store import table
from .oracles import ORACLES


def _scored(spark: SparkSession, sf_dir: str, kind, label: str, cut: float) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), _training.held_out()
    model = kind.train(_training.labelled(docs, table(spark, sf_dir, "labels"), label, kind.MAX_TRAIN, ~held_out))
    return kind.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 0.3)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.components_of(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).select("doc_id", "shard_file", "shard_bytes", "shard_version")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write(table(spark, sf_dir, "pages")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.copies(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_files.read_back(token_files.write(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_decontamination, op4_near_duplicates, op5_sharding, op6_warc, op7_mixing, op8_line_dedup, op9_quality_rules, op10_token_files)}

__all__ = ["ORACLES", "QUERIES"]
