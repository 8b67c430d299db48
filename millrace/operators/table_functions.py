"""FLATTEN: the elements of JSON arrays and objects as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.objects import path_of
from ..functions.values import col

LEVELS = 64
_OUT = ("seq", "key", "path", "index", "value", "this")
_WANTED = {"ARRAY": "^ARRAY", "OBJECT": "^OBJECT", "BOTH": "^(ARRAY|OBJECT)"}


def lateral_flatten(df: DataFrame, source: str | Column, path: str | None = None, outer: bool = False, recursive: bool = False, mode: str = "BOTH", prefix: str = "") -> DataFrame:
    """df with a row for each element of the JSON in source (at path, if given).

    New columns, each with the prefix: seq (same for the elements of one input), key (of object entries), path, index (of
    array elements, from 0), value and this (JSON texts of the element and of what holds it). mode is ARRAY, OBJECT or
    BOTH. outer keeps rows without elements. recursive adds the elements of elements, whatever their depth up to LEVELS.

    The input is read once: each level is one Generate over the rows that the level above has given, which it passes on
    beside their elements. How many levels there are is found by one aggregate over the source beforehand, if recursive.
    """
    mode = mode.upper()
    if mode not in _WANTED:
        raise ValueError(f"mode: {mode}")
    root = F.try_parse_json(col(source))
    root = F.try_variant_get(root, path_of(path), "variant") if path else root
    depth = 1
    if recursive and (depth := df.select(F.max(_depth(F.to_json(root)))).first()[0] or 1) > LEVELS:
        raise ValueError(f"JSON is nested deeper than {LEVELS} levels")

    explode = F.explode_outer if outer else F.explode
    wanted = F.schema_of_variant("__v").rlike(_WANTED["BOTH" if recursive else mode])
    rows = df.withColumn("__v", root).withColumn("__seq", F.monotonically_increasing_id())
    rows = rows.withColumn("__e", explode(F.when(wanted, _elements(F.col("__v"), F.lit(path or "")))))
    for _ in range(depth - 1):
        below = F.when(F.col("__e.last"), _elements(F.col("__e.value"), F.col("__e.path")))
        here = F.struct("__e.index", "__e.key", "__e.path", "__e.value", F.lit(False).alias("last"))
        rows = rows.withColumn("__n", F.explode(F.concat(F.array(here), F.coalesce(below, F.array().cast(_ELEMENTS)))))
        rows = rows.withColumn("__v", F.when(F.col("__n.last"), F.col("__e.value")).otherwise(F.col("__v"))).withColumn("__e", F.col("__n")).drop("__n")
    missing = F.col("__e.path").isNull()
    if recursive and mode != "BOTH":
        rows = rows.where(F.col("__e.index" if mode == "ARRAY" else "__e.key").isNotNull() | missing)
    value = F.when(~missing, F.coalesce(F.to_json("__e.value"), F.lit("null")))
    cells = (F.col("__seq"), F.col("__e.key"), F.col("__e.path"), F.col("__e.index"), value, F.to_json("__v"))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), *(c.alias(prefix + n) for c, n in zip(cells, _OUT, strict=True)))


_ELEMENTS = "array<struct<index:bigint,key:string,path:string,value:variant,last:boolean>>"


def _elements(v: Column, path: Column) -> Column:
    """The elements of an array, or the entries of an object, with their paths; null for other values."""
    def element(index: Column, key: Column, step: Column, value: Column) -> Column:
        return F.struct(index.cast("long").alias("index"), key.cast("string").alias("key"), F.concat(path, step).alias("path"), value.alias("value"), F.lit(True).alias("last"))

    items = F.transform(v.try_cast("array<variant>"), lambda e, i: element(i, F.lit(None), F.concat(F.lit("["), i, F.lit("]")), e))
    dot = F.when(path == "", "").otherwise(".")
    entries = F.transform(F.map_entries(v.try_cast("map<string,variant>")), lambda e: element(F.lit(None), e.key, F.concat(dot, e.key), e.value))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), items).when(F.schema_of_variant(v).startswith("OBJECT"), entries)


def _depth(json: Column) -> Column:
    """How deep arrays and objects are nested in JSON text, from its brackets outside of strings."""
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), "[^\\[\\]{}]+", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        n = s.open + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(n.alias("open"), F.greatest(s.most, n).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: s.most)
