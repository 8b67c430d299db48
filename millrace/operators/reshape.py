"""PIVOT and UNPIVOT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, aggregate: str, of: str) -> DataFrame:
    """For each group of keys a column for each value of `column`, with the aggregate of `of` over the rows that have it. Values are given, so no pass looks for them."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(getattr(F, aggregate)(of))


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value", include_nulls: bool = False) -> DataFrame:
    """A row for each of the columns, with its name and value: one pass over df."""
    out = df.unpivot(list(keys), list(columns), name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())
