"""JSON text: parsing, printing, kinds and conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    """A Column from a Column, a column's name, or (for other types) a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def canonical(x) -> Column:
    """Compact JSON text with sorted keys; null where x isn't JSON."""
    return F.to_json(F.try_parse_json(col(x)))


def parse_json(x) -> Column:
    """Compact JSON text with sorted keys; text that isn't JSON is an error."""
    return F.to_json(F.parse_json(col(x)))


try_parse_json = canonical


def json_value(x, is_text: bool = True) -> Column:
    """JSON text of an SQL value. Text that is JSON is taken as JSON, other text as a JSON string."""
    plain = F.to_json(col(x).cast("variant"))
    return F.coalesce(canonical(col(x).cast("string")), plain) if is_text else plain


def to_json(x, is_text: bool = True) -> Column:
    return json_value(x, is_text)


to_variant = to_json


def elements(x) -> Column:
    """The elements of a JSON array as an array of JSON texts; null where x isn't a JSON array."""
    return F.transform(F.try_parse_json(col(x)).try_cast("array<variant>"), lambda e: F.coalesce(F.to_json(e), F.lit("null")))


def as_array(texts: Column) -> Column:
    """A JSON array of an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def kind(x) -> Column:
    return F.schema_of_variant(F.try_parse_json(col(x)))


def _is(x, pattern: str) -> Column:
    return F.when(col(x).isNotNull(), F.coalesce(kind(x).rlike(pattern), F.lit(False)))


def is_array(x) -> Column:
    return _is(x, "^ARRAY<")


def is_object(x) -> Column:
    return _is(x, "^OBJECT<")


def is_null_value(x) -> Column:
    return _is(x, "^VOID$")


def is_boolean(x) -> Column:
    return _is(x, "^BOOLEAN$")


def _unsigned(x) -> Column:
    """Whether x is an integer from 2**63 to 2**64 - 1, which a VARIANT holds as a decimal."""
    value = canonical(x).try_cast("decimal(38,0)")
    return F.when(col(x).isNotNull(), F.coalesce(_is(x, "^DECIMAL\\([0-9]+,0\\)$") & value.between(F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")), F.lit(False)))


def is_integer(x) -> Column:
    return _is(x, "^BIGINT$") | _unsigned(x)


def is_decimal(x) -> Column:
    return _is(x, "^(DECIMAL|DOUBLE|FLOAT)") & ~_unsigned(x)


def typeof(x) -> Column:
    """NULL_VALUE, BOOLEAN, INTEGER, DECIMAL, VARCHAR, ARRAY or OBJECT; text that isn't JSON is VARCHAR."""
    k = kind(x)
    return F.when(col(x).isNotNull(), F.when(k.isNull(), "VARCHAR").when(k == "VOID", "NULL_VALUE").when(k == "BOOLEAN", "BOOLEAN").when((k == "BIGINT") | _unsigned(x), "INTEGER")
                  .when(k.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "DECIMAL").when(k.startswith("ARRAY"), "ARRAY").when(k.startswith("OBJECT"), "OBJECT").otherwise("VARCHAR"))


def to_array(x) -> Column:
    """JSON arrays as they are, other values as an array of one."""
    return F.when(kind(x).startswith("ARRAY"), canonical(x)).otherwise(F.concat(F.lit("["), json_value(x), F.lit("]")))


def to_object(x) -> Column:
    """JSON objects as they are, other values null."""
    return F.when(kind(x).startswith("OBJECT"), canonical(x))
