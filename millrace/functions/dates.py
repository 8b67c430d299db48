"""Dates and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import col

#: Names of units, with the unit that each stands for. The dialect's aliases.
UNITS = {
    "year": "year", "years": "year", "y": "year", "yy": "year", "yyyy": "year",
    "quarter": "quarter", "quarters": "quarter", "q": "quarter", "qtr": "quarter",
    "month": "month", "months": "month", "mon": "month", "mm": "month",
    "week": "week", "weeks": "week", "w": "week", "wk": "week",
    "day": "day", "days": "day", "d": "day", "dd": "day",
    "hour": "hour", "hours": "hour", "h": "hour", "hh": "hour",
    "minute": "minute", "minutes": "minute", "m": "minute", "mi": "minute", "min": "minute",
    "second": "second", "seconds": "second", "s": "second", "sec": "second", "ss": "second",
    "millisecond": "millisecond", "milliseconds": "millisecond", "ms": "millisecond",
    "microsecond": "microsecond", "microseconds": "microsecond", "us": "microsecond",
    "nanosecond": "nanosecond", "nanoseconds": "nanosecond", "ns": "nanosecond",
}
#: Date formats in the order in which they are tried. Fixed values.
TO_DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d-M-yyyy", "d/M/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")
TRY_TO_DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy", "yyyyMMdd")
TO_TIMESTAMP_FORMATS = ("yyyy-M-d H:m:s[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-M-d'T'H:m:s[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy/M/d H:m:s", "M/d/yyyy H:m:s", "yyyy-M-d H:m", "yyyy-M-d")


def _unit(part: str) -> str:
    if part.lower() not in UNITS:
        raise ValueError(f"unknown date part: {part}")
    return UNITS[part.lower()]


def dateadd(part: str, n, d, is_date: bool = True) -> Column:
    """d (DATE, or a timestamp if not is_date) plus n units; months and longer keep the day, cut to the month's last. Units below a day need a timestamp; nanoseconds are cut to whole microseconds."""
    unit, d = _unit(part), col(d)
    below = {"millisecond": 1_000, "microsecond": 1_000_000, "nanosecond": 1_000_000}.get(unit)
    n = col(n).cast("long" if below else "int")
    months = {"year": 12, "quarter": 3, "month": 1}.get(unit)
    days = {"week": 7, "day": 1}.get(unit)
    if is_date:
        if months:
            return F.add_months(d, n * months)
        if days:
            return F.date_add(d, n * days)
        raise ValueError(f"a DATE has no {unit}")
    zero = F.lit(0)
    if below:
        n = (n - n % 1000) / 1000 if unit == "nanosecond" else n
        return d + F.make_dt_interval(zero, zero, zero, (n.cast("decimal(18,0)") / F.lit(below)).cast("decimal(18,6)"))
    if months:
        return d + F.make_ym_interval(zero, n * months)
    return d + F.make_dt_interval(n * (days or 0), n if unit == "hour" else zero, n if unit == "minute" else zero, (n if unit == "second" else zero).cast("decimal(18,6)"))


def datediff(part: str, a, b) -> Column:
    """b less a. Years and months count calendar boundaries, quarters are three of those months, shorter units count elapsed time, cut towards 0."""
    unit, a, b = _unit(part), col(a), col(b)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("long")
    if unit in ("month", "quarter"):
        return months.cast("long") if unit == "month" else (F.signum(months) * F.floor(F.abs(months) / 3)).cast("long")
    if unit == "nanosecond":
        return F.timestamp_diff("MICROSECOND", a, b).cast("long") * 1000
    return F.timestamp_diff(unit.upper(), a, b).cast("long")


def _first(s, formats, strict: bool, parse, what: str) -> Column:
    found = F.coalesce(*(parse(F.trim(col(s)), F.lit(f)) for f in formats))
    return F.when(col(s).isNotNull(), F.coalesce(found, F.raise_error(F.concat(F.lit(f"not a {what}: "), col(s))).cast(what))) if strict else found


def to_date(s, fmt: str | None = None) -> Column:
    """The first of TO_DATE_FORMATS that fits, or fmt; text that fits none is an error."""
    return _first(s, (fmt,) if fmt else TO_DATE_FORMATS, True, lambda x, f: F.try_to_timestamp(x, f).cast("date"), "date")


def try_to_date(s) -> Column:
    return _first(s, TRY_TO_DATE_FORMATS, False, lambda x, f: F.try_to_timestamp(x, f).cast("date"), "date")


def to_timestamp(x, fmt: str | None = None, is_text: bool = True) -> Column:
    """TIMESTAMP_NTZ from text, or from epoch seconds if not is_text."""
    if not is_text:
        return F.timestamp_seconds(col(x)).cast("timestamp_ntz")
    return _first(x, (fmt,) if fmt else TO_TIMESTAMP_FORMATS, True, lambda s, f: F.try_to_timestamp(s, f).cast("timestamp_ntz"), "timestamp_ntz")


def last_day(d) -> Column:
    return F.last_day(col(d))


def dayname(d) -> Column:
    return F.dayname(col(d))


def monthname(d) -> Column:
    return F.monthname(col(d))
