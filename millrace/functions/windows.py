"""Window functions of the dialect, over a pyspark Window."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from .values import col


def ratio_to_report(x, over: WindowSpec) -> Column:
    """x as a share of the window's sum; null where that is 0."""
    return F.try_divide(col(x).cast("double"), F.sum(col(x).cast("double")).over(over))


def conditional_true_event(condition, over: WindowSpec) -> Column:
    """Rows so far on which the condition is true. over needs an order."""
    return F.sum(F.when(col(condition), 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)).cast("long")


def conditional_change_event(x, over: WindowSpec) -> Column:
    """0 on the first row, one more on each row whose value differs from the row before; null equals null. over needs an order."""
    changed = (F.row_number().over(over) > 1) & ~col(x).eqNullSafe(F.lag(col(x)).over(over))
    return F.sum(F.when(changed, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
