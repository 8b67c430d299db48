"""Conditions, null handling, and arithmetic that tests its divisor."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import col


def iff(condition, then, otherwise) -> Column:
    return F.when(col(condition), col(then)).otherwise(col(otherwise))


def nvl(a, b) -> Column:
    return F.coalesce(col(a), col(b))


ifnull = nvl


def nvl2(a, then, otherwise) -> Column:
    return F.when(col(a).isNotNull(), col(then)).otherwise(col(otherwise))


def decode(value, *pairs) -> Column:
    """Result of the first search that equals value (null equals null), else the last argument where their number is odd, else null."""
    out = None
    for search, result in zip(pairs[::2], pairs[1::2]):
        match = col(value).eqNullSafe(col(search))
        out = F.when(match, col(result)) if out is None else out.when(match, col(result))
    if out is None:
        raise ValueError("decode needs a search and a result")
    return out.otherwise(col(pairs[-1])) if len(pairs) % 2 else out


def zeroifnull(x) -> Column:
    return F.coalesce(col(x), F.lit(0))


def nullifzero(x) -> Column:
    return F.nullif(col(x), F.lit(0))


def div0(a, b) -> Column:
    """Quotient as DOUBLE, 0 where the divisor is 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def div0null(a, b) -> Column:
    """Quotient as DOUBLE, null where the divisor is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def truncate(x, digits: int = 0) -> Column:
    """x, as it is written in decimal, cut after this many decimal places, towards 0."""
    x = col(x).cast("double")
    cut = F.floor(F.abs(x).try_cast("decimal(38,18)"), F.lit(min(digits, 18))).cast("double")
    return F.coalesce(F.signum(x) * cut, x)  # beyond a decimal's range a DOUBLE has no decimal places


trunc_number = truncate
