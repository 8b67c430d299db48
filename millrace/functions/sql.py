"""The dialect's functions for spark.sql: temporary SQL functions, which Spark inlines into the plans that use them.

Only functions of fixed types and number of arguments can be such functions. Those of any type or number (IFF, DECODE,
ARRAY_CONSTRUCT, OBJECT_CONSTRUCT, ...) are Columns in millrace.functions; in SQL, Spark's own IF, CASE, NVL, NVL2 and DECODE
do the same. Names that Spark has with another meaning (SPLIT, TYPEOF, GET, ARRAY_APPEND, ...) have the prefix json_ here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_ELEMENTS = "transform(try_cast(try_parse_json({0}) AS ARRAY<VARIANT>), e -> coalesce(to_json(e), 'null'))"
_MAP = "try_cast(try_parse_json({0}) AS MAP<STRING, VARIANT>)"
_J = "coalesce(to_json(try_parse_json({0})), to_json(cast({0} AS VARIANT)))"
_PATH = "concat('$', regexp_replace(regexp_replace(concat('.', {0}), '\\\\[([0-9]+)\\\\]', '.$1'), '\\\\.([0-9]+)(?=\\\\.|$)', '[$1]'))"
_KIND = "schema_of_variant(try_parse_json({0}))"
_TOKENS = "filter(split({0}, concat('[', regexp_replace({1}, '([\\\\]\\\\[\\\\\\\\^&-])', '\\\\\\\\$1'), ']')), x -> x <> '')"


def _array(body: str) -> str:
    return f"concat('[', array_join({body}, ','), ']')"


def _is(pattern: str) -> str:
    return f"CASE WHEN s IS NOT NULL THEN coalesce({_KIND.format('s')} RLIKE '{pattern}', false) END"


def _text(v: str) -> str:
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN cast({v} AS STRING) ELSE to_json({v}) END"


_E, _VALUE = _ELEMENTS.format("a"), f"try_variant_get(try_parse_json(j), {_PATH.format('p')}, 'variant')"

#: name -> (parameters, type, body)
FUNCTIONS = {
    "div0": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b = 0 THEN 0D ELSE a / b END"),
    "div0null": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(a, b)"),
    "truncate": ("x DOUBLE, n INT DEFAULT 0", "DOUBLE", "signum(x) * CASE WHEN n BETWEEN 0 AND 9 AND abs(x) < 1e15 THEN cast(floor(cast(abs(x) AS DECIMAL(27,12)) * cast(power(10, n) AS DECIMAL(10,0))) AS DOUBLE) ELSE floor(abs(x) * power(10, n)) END / power(10, n)"),
    "charindex": ("part STRING, s STRING, start INT DEFAULT 1", "BIGINT", "locate(part, s, start)"),
    "strtok": ("s STRING, delimiters STRING DEFAULT ' ', n INT DEFAULT 1", "STRING", f"get({_TOKENS.format('s', 'delimiters')}, n - 1)"),
    "strtok_to_array": ("s STRING, delimiters STRING DEFAULT ' '", "STRING", _array(f"transform({_TOKENS.format('s', 'delimiters')}, x -> to_json(cast(x AS VARIANT)))")),
    "json_split": ("s STRING, delimiter STRING", "STRING", _array("transform(split(s, concat('\\\\Q', delimiter, '\\\\E')), x -> to_json(cast(x AS VARIANT)))")),
    "try_to_boolean": ("s STRING", "BOOLEAN", "CASE WHEN lower(trim(s)) IN ('true', 't', 'yes', 'y', 'on', '1') THEN true WHEN lower(trim(s)) IN ('false', 'f', 'no', 'n', 'off', '0') THEN false WHEN try_cast(trim(s) AS DOUBLE) = floor(try_cast(trim(s) AS DOUBLE)) THEN try_cast(trim(s) AS DOUBLE) <> 0 END"),
    "json_canonical": ("s STRING", "STRING", "to_json(try_parse_json(s))"),
    "json_typeof": ("s STRING", "STRING", f"CASE WHEN s IS NULL THEN NULL WHEN {_KIND.format('s')} IS NULL THEN 'VARCHAR' WHEN {_KIND.format('s')} = 'VOID' THEN 'NULL_VALUE' WHEN {_KIND.format('s')} = 'BIGINT' THEN 'INTEGER' WHEN {_KIND.format('s')} RLIKE '^(DECIMAL|DOUBLE|FLOAT)' THEN 'DECIMAL' WHEN {_KIND.format('s')} = 'BOOLEAN' THEN 'BOOLEAN' WHEN {_KIND.format('s')} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {_KIND.format('s')} LIKE 'OBJECT%' THEN 'OBJECT' ELSE 'VARCHAR' END"),
    "is_array": ("s STRING", "BOOLEAN", _is("^ARRAY<")), "is_object": ("s STRING", "BOOLEAN", _is("^OBJECT<")), "is_null_value": ("s STRING", "BOOLEAN", _is("^VOID$")),
    "is_boolean": ("s STRING", "BOOLEAN", _is("^BOOLEAN$")), "is_integer": ("s STRING", "BOOLEAN", _is("^BIGINT$")), "is_decimal": ("s STRING", "BOOLEAN", _is("^(DECIMAL|DOUBLE|FLOAT)")),
    "get_path": ("j STRING, p STRING", "STRING", _text(_VALUE)),
    "object_keys": ("o STRING", "STRING", _array(f"transform(array_sort(map_keys({_MAP.format('o')})), k -> to_json(cast(k AS VARIANT)))")),
    "json_array_size": ("a STRING", "BIGINT", "size(try_cast(try_parse_json(a) AS ARRAY<VARIANT>))"),
    "flatten_array": ("a STRING, i INT", "STRING", f"get({_E}, i)"),
    "json_array_append": ("a STRING, x STRING", "STRING", _array(f"concat({_E}, array({_J.format('x')}))")),
    "json_array_prepend": ("a STRING, x STRING", "STRING", _array(f"concat(array({_J.format('x')}), {_E})")),
    "array_cat": ("a STRING, b STRING", "STRING", _array(f"concat({_E}, {_ELEMENTS.format('b')})")),
    "array_slice": ("a STRING, f INT, t INT", "STRING", _array(f"slice({_E}, greatest(f, 0) + 1, greatest(greatest(t, 0) - greatest(f, 0), 0))")),
    "json_array_contains": ("x STRING, a STRING", "BOOLEAN", f"array_contains({_E}, {_J.format('x')})"),
    "json_array_position": ("x STRING, a STRING", "BIGINT", f"nullif(array_position({_E}, {_J.format('x')}), 0) - 1"),
    "json_array_distinct": ("a STRING", "STRING", _array(f"array_distinct({_E})")),
    "to_variant": ("x STRING", "STRING", _J.format("x")),
    "to_array": ("x STRING", "STRING", f"CASE WHEN {_KIND.format('x')} LIKE 'ARRAY%' THEN to_json(try_parse_json(x)) ELSE concat('[', {_J.format('x')}, ']') END"),
    "to_object": ("x STRING", "STRING", f"CASE WHEN {_KIND.format('x')} LIKE 'OBJECT%' THEN to_json(try_parse_json(x)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
