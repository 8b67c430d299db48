"""JSON arrays. Positions count from 0. Null where an argument isn't a JSON array."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import as_array, col, elements, json_value


def array_construct(*values) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(json_value(v), F.lit("null")) for v in values)), F.lit("]"))


def array_construct_compact(*values) -> Column:
    """Without nulls."""
    return F.concat(F.lit("["), F.concat_ws(",", *(json_value(v) for v in values)), F.lit("]"))


def array_append(a, x) -> Column:
    return as_array(F.concat(elements(a), F.array(F.coalesce(json_value(x), F.lit("null")))))


def array_prepend(a, x) -> Column:
    return as_array(F.concat(F.array(F.coalesce(json_value(x), F.lit("null"))), elements(a)))


def array_cat(a, b) -> Column:
    return as_array(F.concat(elements(a), elements(b)))


def array_slice(a, start, stop) -> Column:
    """Elements start to stop, stop left out; negative ones count as 0."""
    first, last = F.greatest(col(start), F.lit(0)), F.greatest(col(stop), F.lit(0))
    return as_array(F.slice(elements(a), first.cast("int") + 1, F.greatest(last - first, F.lit(0)).cast("int")))


def array_contains(x, a) -> Column:
    """The element comes first."""
    return F.array_contains(elements(a), json_value(x))


def array_position(x, a) -> Column:
    """Null where the element is missing."""
    return F.nullif(F.array_position(elements(a), json_value(x)), F.lit(0)) - 1


def array_distinct(a) -> Column:
    return as_array(F.array_distinct(elements(a)))


def array_flatten(a) -> Column:
    """One level; elements that aren't arrays stay."""
    return as_array(F.flatten(F.transform(elements(a), lambda e: F.coalesce(elements(e), F.array(e)))))


def array_size(a) -> Column:
    return F.size(F.try_parse_json(col(a)).try_cast("array<variant>")).cast("long")


def flatten_array(a, position) -> Column:
    """The element as JSON text; null out of range."""
    return F.get(elements(a), col(position).cast("int"))
