"""Goldens of the dialect's functions, on literals and on columns of several rows with nulls and malformed values."""

import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql.functions import lit as L

from millrace import functions as X

DATE, STAMP = "date", "timestamp_ntz"


def d(text):
    return L(text).cast(DATE)


# name, expression (made when the session is up), expected
GOLDENS = [
    ("iff", lambda: X.iff(L(1) == 1, L("yes"), L("no")), "yes"), ("iff_null", lambda: X.iff(L(None).cast("boolean"), L("a"), L("b")), "b"),
    ("nvl", lambda: X.nvl(L(10), L(20)), 10), ("nvl2", lambda: X.nvl2(L(10), L("has value"), L("no value")), "has value"),
    ("decode", lambda: X.decode(L(1), L(1), L("one"), L(2), L("two"), L("other")), "one"), ("decode_else", lambda: X.decode(L(3), L(1), L("one"), L("other")), "other"),
    ("decode_null", lambda: X.decode(L(None).cast("int"), L(None).cast("int"), L("null"), L("other")), "null"),
    ("to_json", lambda: X.to_json(L(42), False), "42"), ("try_parse_json", lambda: X.try_parse_json(L("not valid json")), None), ("parse_json", lambda: X.parse_json(L('{"b": 1, "a": [true, null]}')), '{"a":[true,null],"b":1}'),
    ("dateadd_day", lambda: X.dateadd("day", 5, d("2024-01-15")).cast("string"), "2024-01-20"), ("dateadd_month", lambda: X.dateadd("mon", 1, d("2024-01-31")).cast("string"), "2024-02-29"),
    ("dateadd_year", lambda: X.dateadd("yy", 1, d("2024-02-29")).cast("string"), "2025-02-28"), ("dateadd_hour", lambda: X.dateadd("hour", 5, L("2024-01-15 20:00:00").cast(STAMP), False).cast("string"), "2024-01-16 01:00:00"),
    ("datediff_day", lambda: X.datediff("day", d("2024-01-01"), d("2024-01-15")), 14), ("datediff_month", lambda: X.datediff("month", d("2024-01-31"), d("2024-02-01")), 1), ("datediff_quarter", lambda: X.datediff("quarter", d("2024-03-31"), d("2024-04-01")), 0),
    ("try_to_number", lambda: X.try_to_number(L(" 42.5 ")), 42.5), ("try_to_number_bad", lambda: X.try_to_number(L("not a number")), None),
    ("try_to_boolean", lambda: X.try_to_boolean(L("on")), True), ("try_to_boolean_no", lambda: X.try_to_boolean(L("no")), False), ("try_to_boolean_bad", lambda: X.try_to_boolean(L("maybe")), None),
    ("array_size", lambda: X.array_size(L("[1, 2, 3, 4, 5]")), 5), ("array_size_empty", lambda: X.array_size(L("[]")), 0), ("array_size_object", lambda: X.array_size(L("{}")), None),
    ("flatten_array", lambda: X.flatten_array(L("[1, 2, 3]"), 1), "2"), ("flatten_array_out", lambda: X.flatten_array(L("[1]"), -1), None),
    ("get_path", lambda: X.get_path(L('{"user": {"address": {"city": "Tokyo"}}}'), "user.address.city"), "Tokyo"), ("get_path_null", lambda: X.get_path(L('{"a": [1, {"b": null}]}'), "a[1].b"), "null"), ("get_path_none", lambda: X.get_path(L('{"a": 1}'), "b.c"), None),
    ("get", lambda: X.get(L("[10, 20, 30]"), 1), "20"), ("get_key", lambda: X.get(L('{"a": 1, "b": 2}'), "b"), "2"),
    ("is_array", lambda: X.is_array(L("[1, 2, 3]")), True), ("is_array_bad", lambda: X.is_array(L("nope")), False), ("is_object", lambda: X.is_object(L('{"a": 1}')), True),
    ("is_integer", lambda: X.is_integer(L("7")), True), ("is_decimal", lambda: X.is_decimal(L("7.5")), True), ("is_boolean", lambda: X.is_boolean(L("true")), True), ("is_null_value", lambda: X.is_null_value(L("null")), True),
    ("typeof_array", lambda: X.typeof(L("[1, 2, 3]")), "ARRAY"), ("typeof_object", lambda: X.typeof(L('{"a": 1}')), "OBJECT"), ("typeof_integer", lambda: X.typeof(L("42")), "INTEGER"), ("typeof_null", lambda: X.typeof(L("null")), "NULL_VALUE"),
    ("array_construct", lambda: X.array_construct(L(1), L(None).cast("string"), L("x"), L("[1]")), '[1,null,"x",[1]]'), ("array_construct_compact", lambda: X.array_construct_compact(L(1), L(None).cast("string"), L(3)), "[1,3]"),
    ("array_append", lambda: X.array_append(L("[1, 2]"), L(3)), "[1,2,3]"), ("array_prepend", lambda: X.array_prepend(L("[1, 2]"), L(0)), "[0,1,2]"), ("array_cat", lambda: X.array_cat(L("[1, 2]"), L("[3, 4]")), "[1,2,3,4]"), ("array_cat_bad", lambda: X.array_cat(L("[1]"), L("{}")), None),
    ("array_slice", lambda: X.array_slice(L("[1,2,3,4]"), 1, 3), "[2,3]"), ("array_slice_negative", lambda: X.array_slice(L("[1,2]"), -3, 1), "[1]"), ("array_contains", lambda: X.array_contains(L(2), L("[1, 2, 3]")), True), ("array_contains_no", lambda: X.array_contains(L(5), L("[1, 2, 3]")), False),
    ("array_position", lambda: X.array_position(L(3), L("[1, 2, 3]")), 2), ("array_position_none", lambda: X.array_position(L(9), L("[1]")), None), ("array_distinct", lambda: X.array_distinct(L("[1, 2, 2, 3, 1]")), "[1,2,3]"), ("array_flatten", lambda: X.array_flatten(L("[[1, 2], [3, 4], 5]")), "[1,2,3,4,5]"),
    ("object_construct", lambda: X.object_construct(L("b"), L(2), L("a"), L("x"), L("n"), L(None).cast("string")), '{"a":"x","b":2}'), ("object_construct_keep_null", lambda: X.object_construct_keep_null(L("n"), L(None).cast("string")), '{"n":null}'),
    ("object_construct_repeat", lambda: X.object_construct(L("a"), L(1), L("a"), L(2)), '{"a":2}'),
    ("object_insert", lambda: X.object_insert(L('{"a": 1}'), L("b"), L(2)), '{"a":1,"b":2}'), ("object_insert_same", lambda: X.object_insert(L('{"a": 1}'), L("a"), L(2)), '{"a":1}'), ("object_insert_update", lambda: X.object_insert(L('{"a": 1}'), L("a"), L(2), True), '{"a":2}'),
    ("object_delete", lambda: X.object_delete(L('{"a": 1, "b": 2}'), "a"), '{"b":2}'), ("object_pick", lambda: X.object_pick(L('{"a": 1, "b": 2, "c": 3}'), "a", "c"), '{"a":1,"c":3}'), ("object_keys", lambda: X.object_keys(L('{"b": 1, "a": 2}')), '["a","b"]'), ("object_keys_array", lambda: X.object_keys(L("[1]")), None),
    ("to_variant", lambda: X.to_variant(L("abc")), '"abc"'), ("to_array", lambda: X.to_array(L("[1, 2, 3]")), "[1,2,3]"), ("to_array_one", lambda: X.to_array(L("42")), "[42]"), ("to_object", lambda: X.to_object(L("[1, 2, 3]")), None),
    ("split", lambda: X.split(L("a.b.c"), "."), '["a","b","c"]'), ("strtok", lambda: X.strtok(L("a.b.c"), ".", 2), "b"), ("strtok_out", lambda: X.strtok(L("a.b"), ".", 5), None), ("strtok_to_array", lambda: X.strtok_to_array(L("a.-b]c"), ".-]"), '["a","b","c"]'),
    ("regexp_like", lambda: X.regexp_like(L("abc123"), "[0-9]+"), True), ("regexp_substr", lambda: X.regexp_substr(L("abc123def"), "[0-9]+"), "123"), ("regexp_substr_none", lambda: X.regexp_substr(L("abc"), "[0-9]+"), None), ("regexp_replace", lambda: X.regexp_replace(L("abc123def"), "[0-9]+", "XXX"), "abcXXXdef"), ("regexp_count", lambda: X.regexp_count(L("abab"), "ab"), 2),
    ("charindex", lambda: X.charindex("bar", L("foobar")), 4), ("charindex_umlaut", lambda: X.charindex("b", L("äöb")), 3), ("reverse", lambda: X.reverse(L("hello")), "olleh"), ("lpad", lambda: X.lpad(L("123"), 5, "0"), "00123"), ("rpad", lambda: X.rpad(L("123"), 5, "0"), "12300"), ("translate", lambda: X.translate(L("abc"), "abc", "12"), "12"),
    ("to_date", lambda: X.to_date(L("2024-3-15")).cast("string"), "2024-03-15"), ("to_date_us", lambda: X.to_date(L("03/15/2024")).cast("string"), "2024-03-15"), ("try_to_date", lambda: X.try_to_date(L("5/3/2024")).cast("string"), "2024-03-05"), ("try_to_date_bad", lambda: X.try_to_date(L("nope")), None),
    ("to_timestamp", lambda: X.to_timestamp(L("2024-03-15 10:11:12")).cast("string"), "2024-03-15 10:11:12"), ("to_timestamp_epoch", lambda: X.to_timestamp(L(0), is_text=False).cast("string"), "1970-01-01 00:00:00"),
    ("last_day", lambda: X.last_day(d("2024-02-15")).cast("string"), "2024-02-29"), ("dayname", lambda: X.dayname(d("2024-01-15")), "Mon"), ("monthname", lambda: X.monthname(d("2024-12-25")), "Dec"),
    ("div0", lambda: X.div0(L(10), L(2)), 5.0), ("div0_zero", lambda: X.div0(L(10), L(0)), 0.0), ("div0null", lambda: X.div0null(L(10), L(0)), None), ("truncate", lambda: X.truncate(L(-1.289), 2), -1.28),
    ("truncate_435", lambda: X.truncate(L(4.35), 2), 4.35), ("truncate_029", lambda: X.truncate(L(0.29), 2), 0.29), ("truncate_tens", lambda: X.truncate(L(-45.0), -1), -40.0), ("truncate_large", lambda: X.truncate(L(1e30), 2), 1e30),
    ("dateadd_ms", lambda: X.dateadd("ms", 1500, L("2024-01-15 20:00:00").cast(STAMP), False).cast("string"), "2024-01-15 20:00:01.5"), ("dateadd_us", lambda: X.dateadd("microseconds", -1, L("2024-01-15 20:00:00").cast(STAMP), False).cast("string"), "2024-01-15 19:59:59.999999"),
    ("dateadd_ns", lambda: X.dateadd("ns", 2999, L("2024-01-15 20:00:00").cast(STAMP), False).cast("string"), "2024-01-15 20:00:00.000002"), ("dateadd_ss", lambda: X.dateadd("SS", 61, L("2024-01-15 20:00:00").cast(STAMP), False).cast("string"), "2024-01-15 20:01:01"),
    ("datediff_ms", lambda: X.datediff("ms", L("2024-01-15 20:00:00").cast(STAMP), L("2024-01-15 20:00:01.25").cast(STAMP)), 1250), ("datediff_ns", lambda: X.datediff("ns", L("2024-01-15 20:00:00").cast(STAMP), L("2024-01-15 20:00:00.000004").cast(STAMP)), 4000), ("datediff_us", lambda: X.datediff("us", L("2024-01-15 20:00:00").cast(STAMP), L("2024-01-15 19:59:59").cast(STAMP)), -1_000_000),
    ("regexp_bad", lambda: X.regexp_like(L("abc"), "[a"), None), ("regexp_substr_bad", lambda: X.regexp_substr(L("abc"), "("), None), ("regexp_replace_bad", lambda: X.regexp_replace(L("abc"), "*"), None), ("regexp_count_bad", lambda: X.regexp_count(L("abc"), "a{2"), None),
    ("object_insert_null", lambda: X.object_insert(L('{"a": 1}'), L(None).cast("string"), L(2)), None), ("get_quoted", lambda: X.get(L('{"it\'s": 5}'), "it's"), "5"), ("get_quotes", lambda: X.get(L('{"a\'\\"b": 6}'), "a'\"b"), "6"), ("get_path_quoted", lambda: X.get_path(L('{"it\'s": {"x": 7}}'), "it's.x"), "7"),
    ("typeof_unsigned", lambda: X.typeof(L("18446744073709551615")), "INTEGER"), ("is_integer_unsigned", lambda: X.is_integer(L("9223372036854775808")), True), ("is_decimal_unsigned", lambda: X.is_decimal(L("9223372036854775808")), False), ("typeof_beyond", lambda: X.typeof(L("18446744073709551616")), "DECIMAL"),
    ("try_to_boolean_2", lambda: X.try_to_boolean(L("2")), True),
    ("sha1", lambda: X.sha1(L("hello")), "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d"), ("sha2", lambda: F.substr(X.sha2(L("hello")), L(1), L(8)), "2cf24dba"),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.range(1).select(*(make().alias(name) for name, make, _ in GOLDENS)).first()


@pytest.mark.parametrize(("name", "expected"), [(n, e) for n, _, e in GOLDENS])
def test_golden(results, name, expected):
    assert results[name] == expected


def test_strict_forms_fail_and_try_forms_give_null(spark):
    bad = spark.createDataFrame([("x",)], "s string")
    for strict in (X.parse_json("s"), X.to_date("s"), X.to_timestamp("s")):
        with pytest.raises(Exception):
            bad.select(strict).collect()
    assert bad.select(X.try_parse_json("s"), X.try_to_date("s"), X.try_to_number("s")).first() == (None, None, None)


def test_columns_with_nulls_and_malformed_values(spark):
    rows = spark.createDataFrame([("[1, 2]",), ("[]",), ("{}",), ("[1",), ("",), (None,), ('["é", null]',)], "a string")
    assert [tuple(r) for r in rows.select(X.array_size("a"), X.array_append("a", L(9)), X.typeof("a"), X.is_array("a")).collect()] == [
        (2, "[1,2,9]", "ARRAY", True), (0, "[9]", "ARRAY", True), (None, None, "OBJECT", False), (None, None, "VARCHAR", False), (None, None, "VARCHAR", False), (None, None, None, None), (2, '["é",null,9]', "ARRAY", True)]


def test_aggregates(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, None, None), (2, None, 4)], "g int, k string, v int")
    got = rows.groupBy("g").agg(X.array_agg("v", ["v"], False).alias("a"), X.object_agg("k", "v", ["v"], False).alias("o"), X.listagg("k", order=["v"]).alias("l")).orderBy("g").collect()
    assert [tuple(r) for r in got] == [(1, "[null,1,2,3]", '{"a":3,"b":2}', "a,b,a"), (2, "[4]", "{}", "")]


def test_windows(spark):
    rows = spark.createDataFrame([(1, True, "A", 100.0), (2, False, "A", 200.0), (3, True, None, 200.0), (4, None, None, 0.0), (5, True, "C", 0.0)], "id int, t boolean, s string, v double")
    w = Window.orderBy("id")
    got = rows.select("id", X.conditional_true_event("t", w).alias("t"), X.conditional_change_event("s", w).alias("c"), X.ratio_to_report("v", Window.partitionBy(F.lit(1))).alias("r")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 0.2), (2, 1, 0, 0.4), (3, 2, 1, 0.4), (4, 2, 1, 0.0), (5, 3, 2, 0.0)]


def test_unknown_date_part():
    with pytest.raises(ValueError):
        X.dateadd("fortnight", 1, "d")


def test_sql_functions_agree_with_columns(spark):
    X.register(spark)
    rows = spark.createDataFrame([("[1, 2, [3]]",), ('{"b": 1, "a": {"c": [5]}}',), ("x",), ("",), (None,), ("2.5",), ("null",)], "s string")
    rows.createOrReplaceTempView("json_rows")
    pairs = {
        "is_array(s)": X.is_array("s"), "is_object(s)": X.is_object("s"), "is_integer(s)": X.is_integer("s"), "is_decimal(s)": X.is_decimal("s"), "is_null_value(s)": X.is_null_value("s"), "json_typeof(s)": X.typeof("s"),
        "get_path(s, 'a.c[0]')": X.get_path("s", "a.c[0]"), "get_path(s, 'a.c.0')": X.get_path("s", "a.c.0"), "object_keys(s)": X.object_keys("s"), "json_array_size(s)": X.array_size("s"), "flatten_array(s, 1)": X.flatten_array("s", 1),
        "array_cat(s, '[9]')": X.array_cat("s", L("[9]")), "array_slice(s, 1, 3)": X.array_slice("s", 1, 3), "json_array_append(s, '7')": X.array_append("s", L("7")), "json_array_position('2', s)": X.array_position(L("2"), "s"),
        "to_array(s)": X.to_array("s"), "to_object(s)": X.to_object("s"), "to_variant(s)": X.to_variant("s"), "strtok_to_array(s, ', ')": X.strtok_to_array("s", ", "), "try_to_boolean(s)": X.try_to_boolean(F.when(F.col("s") != "2.5", F.col("s"))),
    }
    got = spark.sql("SELECT " + ", ".join(pairs) + " FROM json_rows").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in rows.select(*pairs.values()).collect()]
