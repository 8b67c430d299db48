"""Choosing rows: by window conditions, by rank, by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def qualify(df: DataFrame, condition: str | Column, **windows: Column) -> DataFrame:
    """Rows of df that meet a condition on window expressions, which the condition names; they are not in the result.

    A rank compared with a constant becomes Spark's group limit, so only the first rows of each group are shuffled.
    """
    clash = set(windows) & set(df.columns)
    if clash:
        raise ValueError(f"names of windows are columns already: {sorted(clash)}")
    return df.withColumns(windows).where(condition).drop(*windows)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sample_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows at random (all if there are fewer): a top-n by a random key, so each task sends n rows at most."""
    key = F.rand(seed) if seed is not None else F.rand()
    return df.withColumn("__key", key).orderBy("__key").limit(n).drop("__key")


def sample_percent(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """Each row with this probability; none at 0 or less, all at 100 or more."""
    if percent <= 0:
        return df.where("false")
    return df if percent >= 100 else df.sample(percent / 100, seed)
