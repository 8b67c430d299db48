"""Operators that reshape and choose rows."""

import pytest
from pyspark.sql import Window, functions as F

from millrace import operators as O


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_qualify(spark):
    df = spark.createDataFrame([(1, "A", 10), (2, "A", 20), (3, "B", 30), (4, "B", 40)], "id int, category string, value int")
    assert rows(O.qualify(df, "rn = 1", rn=F.row_number().over(Window.partitionBy("category").orderBy("value")))) == [(1, "A", 10), (3, "B", 30)]
    with pytest.raises(ValueError):
        O.qualify(df, "id = 1", id=F.row_number().over(Window.orderBy("id")))


def test_qualify_uses_a_group_limit(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = O.qualify(df, "rn <= 2", rn=F.row_number().over(Window.partitionBy("g").orderBy("id")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([("Widget", "Q1", 100), ("Widget", "Q2", 150), ("Gadget", "Q1", 200), ("Gadget", "Q2", 250)], "product string, quarter string, amount int")
    wide = O.pivot(df, ["product"], "quarter", ["Q1", "Q2"], "sum", "amount")
    assert rows(wide) == [("Gadget", 200, 250), ("Widget", 100, 150)]
    assert rows(O.unpivot(wide, ["product"], ["Q1", "Q2"])) == [("Gadget", "Q1", 200), ("Gadget", "Q2", 250), ("Widget", "Q1", 100), ("Widget", "Q2", 150)]
    gap = spark.createDataFrame([("a", 1, None)], "k string, x int, y int")
    assert (O.unpivot(gap, ["k"], ["x", "y"]).count(), O.unpivot(gap, ["k"], ["x", "y"], include_nulls=True).count()) == (1, 2)


def test_samples(spark):
    df = spark.range(1000)
    assert (O.sample_rows(df, 10).count(), O.sample_rows(df, 5000).count(), O.sample_percent(df, 0).count(), O.sample_percent(df, 100).count()) == (10, 1000, 0, 1000)
    assert 300 < O.sample_percent(df, 50, seed=1).count() < 700


def test_flatten(spark):
    df = spark.createDataFrame([(1, "[10, 20, 30]"), (2, "[40, 50]"), (3, "[]"), (4, None), (5, "{bad")], "id int, arr string")
    assert rows(O.lateral_flatten(df, "arr").select("id", "index", "value")) == [(1, 0, "10"), (1, 1, "20"), (1, 2, "30"), (2, 0, "40"), (2, 1, "50")]
    outer = O.lateral_flatten(df, "arr", outer=True).groupBy("id").agg(F.count("*").alias("n"), F.count("value").alias("v"))
    assert rows(outer) == [(1, 3, 3), (2, 2, 2), (3, 1, 0), (4, 1, 0), (5, 1, 0)]


def test_flatten_path_objects_and_chains(spark):
    df = spark.createDataFrame([(1, '{"items": [{"k": "a"}, {"k": "b", "m": null}], "x": 5}')], "id int, doc string")
    first = O.lateral_flatten(df, "doc", path="items", prefix="f1_")
    assert rows(first.select("f1_path", "f1_index", "f1_value")) == [("items[0]", 0, '{"k":"a"}'), ("items[1]", 1, '{"k":"b","m":null}')]
    assert rows(O.lateral_flatten(first, "f1_value", prefix="f2_").select("f1_index", "f2_key", "f2_value")) == [(0, "k", '"a"'), (1, "k", '"b"'), (1, "m", "null")]
    assert rows(O.lateral_flatten(df, "doc", mode="OBJECT").select("key", "value")) == [("items", '[{"k":"a"},{"k":"b","m":null}]'), ("x", "5")]
    assert O.lateral_flatten(df, "doc", mode="ARRAY").count() == 0


def test_flatten_recursive_and_long(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}')], "id int, doc string")
    assert rows(O.lateral_flatten(df, "doc", recursive=True).select("path", "value")) == [("a", '[1,{"b":2}]'), ("a[0]", "1"), ("a[1]", '{"b":2}'), ("a[1].b", "2")]
    long = spark.range(1).select(F.to_json(F.sequence(F.lit(1), F.lit(5000))).alias("doc"))
    assert O.lateral_flatten(long, "doc").count() == 5000


def test_flatten_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([(1, '{"a": [1, {"b": [2, []]}], "c": "}]\\\\\\"{["}'), (2, "7"), (3, "{}"), (4, None)], "id int, doc string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for outer in (False, True):
        out = O.lateral_flatten(df, "doc", outer=outer, recursive=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan
        assert rows(out.where("path IS NOT NULL").select("id", "path", "value", "this")) == [
            (1, "a", '[1,{"b":[2,[]]}]', '{"a":[1,{"b":[2,[]]}],"c":"}]\\\\\\"{["}'), (1, "a[0]", "1", '[1,{"b":[2,[]]}]'), (1, "a[1]", '{"b":[2,[]]}', '[1,{"b":[2,[]]}]'),
            (1, "a[1].b", "[2,[]]", '{"b":[2,[]]}'), (1, "a[1].b[0]", "2", "[2,[]]"), (1, "a[1].b[1]", "[]", "[2,[]]"), (1, "c", '"}]\\\\\\"{["', '{"a":[1,{"b":[2,[]]}],"c":"}]\\\\\\"{["}')]
        assert rows(out.where("path IS NULL").select("id")) == ([(2,), (3,), (4,)] if outer else [])


def test_flatten_recursive_modes_and_depth(spark):
    df = spark.createDataFrame([(1, '[{"x": [5]}, null]')], "id int, doc string")
    assert rows(O.lateral_flatten(df, "doc", recursive=True, mode="ARRAY").select("path", "value")) == [("[0]", '{"x":[5]}'), ("[0].x[0]", "5"), ("[1]", "null")]
    assert rows(O.lateral_flatten(df, "doc", recursive=True, mode="OBJECT", outer=True).select("path", "value")) == [("[0].x", "[5]")]
    deep = spark.createDataFrame([("[" * 65 + "]" * 65,)], "doc string")
    with pytest.raises(ValueError):
        O.lateral_flatten(deep, "doc", recursive=True)
