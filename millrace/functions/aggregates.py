"""Aggregates to JSON text and lists. order makes the result independent of the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import col, json_value


def _ordered(entry: Column, order) -> Column:
    cells = F.collect_list(F.struct(*(col(o).alias(f"o{i}") for i, o in enumerate(order)), entry.alias("e")))
    return F.transform(F.sort_array(cells) if order else cells, lambda c: c.e)


def array_agg(x, order=(), is_text: bool = True) -> Column:
    """JSON array of all values, nulls among them; [] of no rows."""
    return F.concat(F.lit("["), F.array_join(_ordered(F.coalesce(json_value(x, is_text), F.lit("null")), order), ","), F.lit("]"))


def object_agg(key, value, order=(), is_text: bool = True) -> Column:
    """JSON object; rows with a null key are left out, of a repeated key the last value (by order) counts."""
    cells = _ordered(F.when(col(key).isNotNull(), F.struct(col(key).cast("string").alias("k"), F.coalesce(json_value(value, is_text), F.lit("null")).alias("v"))), order)
    cells = F.filter(cells, lambda c: c.isNotNull())
    # Folding keeps the last value of each key: entries by key, then position.
    sorted_ = F.sort_array(F.transform(cells, lambda c, i: F.struct(c.k.alias("k"), i.alias("i"), c.v.alias("v"))))
    last = F.filter(sorted_, lambda c, i: ~F.coalesce(F.get(sorted_, i + 1).k == c.k, F.lit(False)))
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda c: F.concat(F.to_json(c.k.cast("variant")), F.lit(":"), c.v)), ","), F.lit("}"))


def listagg(x, delimiter: str = ",", order=()) -> Column:
    """Values that aren't null, joined; '' of none."""
    return F.coalesce(F.array_join(F.filter(_ordered(col(x).cast("string"), order), lambda e: e.isNotNull()), delimiter), F.lit(""))
