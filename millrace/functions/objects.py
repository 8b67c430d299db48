"""JSON objects and access by key, position and path."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .values import col, json_value

_MAP = "map<string,variant>"


def _map(x) -> Column:
    return F.try_parse_json(col(x)).try_cast(_MAP)


def _print(m: Column) -> Column:
    """JSON text of a map of variants: sorted keys, nulls kept."""
    pairs = F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(F.to_json(k.cast("variant")), F.lit(":"), F.coalesce(F.to_json(F.element_at(m, k)), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _entries(pairs, keep_null: bool) -> Column:
    if len(pairs) % 2:
        raise ValueError("keys and values must pair up")
    cells = [F.struct(col(k).cast("string").alias("k"), json_value(v).alias("v")) for k, v in zip(pairs[::2], pairs[1::2])]
    return F.filter(F.array(*cells), lambda e: e.k.isNotNull() & (F.lit(keep_null) | e.v.isNotNull()))


def _construct(pairs, keep_null: bool) -> Column:
    if not pairs:
        return F.lit("{}")
    # of a repeated key the last value counts
    cells = _entries(pairs, keep_null)
    last = F.filter(cells, lambda e, i: ~F.exists(F.slice(cells, i + 2, F.greatest(F.size(cells) - i - 1, F.lit(0))), lambda o: o.k == e.k))
    texts = F.transform(F.array_sort(last, lambda a, b: F.when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)), lambda e: F.concat(F.to_json(e.k.cast("variant")), F.lit(":"), F.coalesce(e.v, F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))


def object_construct(*pairs) -> Column:
    """Keys and values in turn; pairs with a null key or value are left out."""
    return _construct(pairs, False)


def object_construct_keep_null(*pairs) -> Column:
    """Pairs with a null key are left out, null values kept."""
    return _construct(pairs, True)


def object_insert(o, key, value, update: bool = False) -> Column:
    """With the key; an object that has it already stays as it is unless update; null for a null key."""
    m, k = _map(o), F.coalesce(col(key).cast("string"), F.lit(""))
    new = F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, F.parse_json(json_value(value))))
    return F.when(col(key).isNotNull(), _print(new if update else F.when(F.map_contains_key(m, k), m).otherwise(new)))


def object_delete(o, *keys: str) -> Column:
    return _print(F.map_filter(_map(o), lambda k, _: ~k.isin(*keys)))


def object_pick(o, *keys: str) -> Column:
    return _print(F.map_filter(_map(o), lambda k, _: k.isin(*keys)))


def object_keys(o) -> Column:
    """JSON array of the keys, sorted."""
    keys = F.array_sort(F.map_keys(_map(o)))
    return F.concat(F.lit("["), F.array_join(F.transform(keys, lambda k: F.to_json(k.cast("variant"))), ","), F.lit("]"))


def path_of(path: str) -> str:
    """A dot path ('a.b.0', 'a[0].b') as a JSON path; parts of digits are positions."""
    parts = [p for p in re.split(r"\.|\[|\]", path) if p]
    return "$" + "".join(f"[{p}]" if p.isdigit() else _step(p) for p in parts)


def _step(key: str) -> str:
    """A key as a step of a JSON path, in the quotes that it doesn't have."""
    if "'" in key and '"' in key:
        raise ValueError(f"a path can't have a key with both kinds of quotes: {key}")
    return f'["{key}"]' if "'" in key else f"['{key}']"


def _text(v: Column) -> Column:
    """Strings as they are, other values as JSON text."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))


def get_path(j, path: str) -> Column:
    """The value at a dot path: strings without quotes, JSON null as the text null; null where it is missing."""
    return _text(F.try_variant_get(F.try_parse_json(col(j)), path_of(path), "variant"))


def get(j, key) -> Column:
    """The element at a position (int or integer Column) or key (text): strings without quotes."""
    v = F.try_parse_json(col(j))
    if isinstance(key, str):
        return _text(F.element_at(v.try_cast("map<string,variant>"), F.lit(key))) if "'" in key and '"' in key else _text(F.try_variant_get(v, f"${_step(key)}", "variant"))
    if isinstance(key, int):
        return _text(F.try_variant_get(v, f"$[{key}]", "variant"))
    return _text(F.get(v.try_cast("array<variant>"), key.cast("int")))


