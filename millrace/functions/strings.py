"""Text, regular expressions, hashes and conversions that give null on failure."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession, functions as F

from .values import col


def _json_strings(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: F.to_json(x.cast("variant"))), ","), F.lit("]"))


def split(s, delimiter: str) -> Column:
    """JSON array of the parts between literal delimiters."""
    return _json_strings(F.split(col(s), re.escape(delimiter)) if delimiter else F.array(col(s)))


def _tokens(s, delimiters: str) -> Column:
    return F.filter(F.split(col(s), "[" + re.sub(r"([\]\[\\^&-])", r"\\\1", delimiters) + "]"), lambda x: x != "") if delimiters else F.array(col(s))


def strtok(s, delimiters: str = " ", n: int = 1) -> Column:
    """The n-th token (from 1) between characters of delimiters; null where there is none."""
    return F.get(_tokens(s, delimiters), F.lit(n - 1)) if n > 0 else F.lit(None).cast("string")


def strtok_to_array(s, delimiters: str = " ") -> Column:
    return _json_strings(_tokens(s, delimiters))


def _fits(pattern: str) -> bool:
    """Whether the pattern is a regular expression; with one that isn't, the functions below are null."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def regexp_like(s, pattern: str) -> Column:
    """Whether the pattern is found anywhere."""
    return col(s).rlike(pattern) if _fits(pattern) else F.lit(None).cast("boolean")


def regexp_substr(s, pattern: str) -> Column:
    return F.regexp_substr(col(s), F.lit(pattern)) if _fits(pattern) else F.lit(None).cast("string")


def regexp_replace(s, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col(s), pattern, replacement) if _fits(pattern) else F.lit(None).cast("string")


def regexp_count(s, pattern: str) -> Column:
    return F.regexp_count(col(s), F.lit(pattern)).cast("long") if _fits(pattern) else F.lit(None).cast("long")


def contains(s, x) -> Column:
    return F.contains(col(s), F.lit(x))


def startswith(s, x) -> Column:
    return F.startswith(col(s), F.lit(x))


def endswith(s, x) -> Column:
    return F.endswith(col(s), F.lit(x))


def charindex(part: str, s, start: int = 1) -> Column:
    """Position of the part in s in characters from 1, 0 where it isn't."""
    return F.locate(part, col(s), start).cast("long")


def reverse(s) -> Column:
    return F.reverse(col(s))


def lpad(s, n: int, pad: str = " ") -> Column:
    return F.lpad(col(s), n, pad)


def rpad(s, n: int, pad: str = " ") -> Column:
    return F.rpad(col(s), n, pad)


def translate(s, source: str, target: str) -> Column:
    return F.translate(col(s), source, target)


def sha1(s) -> Column:
    return F.sha1(col(s).cast("binary"))


def sha2(s, bits: int = 256) -> Column:
    return F.sha2(col(s).cast("binary"), bits)


def try_to_number(x) -> Column:
    return F.trim(col(x).cast("string")).try_cast("double")


def try_to_boolean(x) -> Column:
    s = F.lower(F.trim(col(x).cast("string")))
    n = s.try_cast("double")
    return (F.when(s.isin("true", "t", "yes", "y", "on", "1"), True).when(s.isin("false", "f", "no", "n", "off", "0"), False)
            .when(n.isNotNull() & (n == F.floor(n)), n != 0))
