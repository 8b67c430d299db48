"""The dialect's own operators and functions over the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .. import functions as X, operators as O
from ._tables import plan


def _top3(t):
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return O.qualify(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "rn <= 3", rn=F.row_number().over(w))


def _baskets(t):
    """o_custkey and the JSON array of its order keys."""
    return t.orders.groupBy("o_custkey").agg(X.array_agg("o_orderkey", ["o_orderkey"], False).alias("keys"))


_BASKETS = "(SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)"


def _by_user():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


_NUM = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(t):
    return t.events.select("event_id", "props", X.get_path("props", "k").alias("k"))


def _nested(t):
    """event_id, user_id and doc: {"p": props, "tags": [type, user]} as JSON text."""
    return t.events.select("event_id", "user_id", F.concat(F.lit('{"p": '), "props", F.lit(', "tags": ["'), "event_type", F.lit('", '), "user_id", F.lit("]}")).alias("doc"))


_HAS_DOC = "CASE WHEN props IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL THEN"


def _strings(t):
    name = F.col("p_name")
    return t.part.select("p_partkey", X.split(name, " ").alias("words"), X.strtok(name, " ", 2).alias("second"), X.charindex("a", name).alias("at"), X.reverse(name).alias("back"), X.lpad(name, 12, "*").alias("left"), X.rpad("p_brand", 12, ".").alias("right"),
                         X.translate(name, "abc", "12").alias("swapped"), X.contains(name, "re").alias("has"), X.startswith("p_brand", "Brand").alias("starts"), X.endswith(name, "n").alias("ends"), X.array_size(X.strtok_to_array(name, " ")).alias("n"))


def _dates(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", X.dateadd("month", 1, d).alias("next_month"), X.dateadd("day", -10, d).alias("before"), X.datediff("month", d, F.lit("1998-12-31").cast("date")).alias("months"), X.datediff("day", d, F.lit("1998-12-31").cast("date")).alias("days"),
                           X.datediff("year", d, F.lit("1998-12-31").cast("date")).alias("years"), X.last_day(d).alias("month_end"), X.dayname(d).alias("weekday"), X.monthname(d).alias("month"), F.trunc(d, "MONTH").alias("month_start"), F.year(d).cast("long").alias("y"))


def _conditions(t):
    c = F.col("c_acctbal")
    return t.customer.select("c_custkey", X.iff(c > 0, F.lit("credit"), F.lit("debit")).alias("side"), X.nvl(F.when(c > 0, c), F.lit(0.0)).alias("positive"), X.nvl2(F.when(c > 5000, c), F.lit("rich"), F.lit("-")).alias("rich"),
                             X.decode("c_mktsegment", F.lit("BUILDING"), F.lit("B"), F.lit("MACHINERY"), F.lit("M"), F.lit("?")).alias("segment"),
                             X.zeroifnull(F.when(c > 0, c)).alias("z"), X.nullifzero(F.col("c_nationkey")).alias("nz"))


#: name -> (plan, SQL or None)
DIALECT = {
    "qualify_top3_orders": (plan(_top3), "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3"),
    "qualify_aggregate": (plan(lambda t: O.qualify(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice > 2 * mean", mean=F.avg("o_totalprice").over(W.partitionBy("o_custkey")))),
                          "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY o_totalprice > 2 * avg(o_totalprice) OVER (PARTITION BY o_custkey)"),
    "ratio_to_report": (plan(lambda t: t.orders.select("o_orderkey", F.round(X.ratio_to_report("o_totalprice", W.partitionBy("o_custkey")), 6).alias("share"))),
                        "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders"),
    "cond_true_event": (plan(lambda t: t.events.select("event_id", X.conditional_true_event(F.col("event_type") == "click", _by_user()).alias("n"))),
                        "SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM events"),
    "cond_change_event": (plan(lambda t: t.events.select("event_id", X.conditional_change_event("event_type", _by_user()).alias("n"))),
                          "SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"),
    "pivot_status": (plan(lambda t: O.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "count", "o_orderkey")),
                     "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1"),
    "unpivot_amounts": (plan(lambda t: O.unpivot(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])),
                        "SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem WHERE l_quantity IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL"),
    "flatten_array": (plan(lambda t: O.lateral_flatten(_baskets(t), "keys").select("o_custkey", F.col("index").alias("at"), F.col("value").cast("long").alias("orderkey"))),
                      f"SELECT o_custkey, CAST(i - 1 AS BIGINT) AS at, l[i] AS orderkey FROM (SELECT o_custkey, l, unnest(range(1, len(l) + 1)) AS i FROM {_BASKETS})"),
    "flatten_path": (plan(lambda t: O.lateral_flatten(_baskets(t).select("o_custkey", F.concat(F.lit('{"items": '), "keys", F.lit("}")).alias("doc")), "doc", path="items").select("o_custkey", "path", F.col("value").cast("long").alias("orderkey"))),
                     f"SELECT o_custkey, 'items[' || (i - 1) || ']' AS path, l[i] AS orderkey FROM (SELECT o_custkey, l, unnest(range(1, len(l) + 1)) AS i FROM {_BASKETS})"),
    "flatten_outer": (plan(lambda t: O.lateral_flatten(t.customer.select("c_custkey").join(_baskets(t), F.col("c_custkey") == F.col("o_custkey"), "left"), F.coalesce("keys", F.lit("[]")), outer=True).groupBy("c_custkey").agg(F.count("*").alias("n"), F.count("value").alias("found"))),
                      "SELECT c_custkey, greatest(count(o_orderkey), 1) AS n, count(o_orderkey) AS found FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "flatten_object": (plan(lambda t: O.lateral_flatten(t.events.select("event_id", "props"), "props", mode="OBJECT").select("event_id", "key", F.col("value").cast("long").alias("n"))),
                       f"SELECT event_id, 'k' AS key, {_NUM} AS n FROM events WHERE props IS NOT NULL"),
    "flatten_recursive": (plan(lambda t: O.lateral_flatten(t.events.select("event_id", F.concat(F.lit('{"a": [1, '), "props", F.lit("]}")).alias("doc")), "doc", recursive=True).groupBy("event_id").agg(F.count("*").alias("n"), F.max("path").alias("last"))),
                          "SELECT event_id, 4 AS n, 'a[1].k' AS last FROM events WHERE props IS NOT NULL"),
    "flatten_nested": (plan(lambda t: O.lateral_flatten(t.events.select("event_id", F.concat(F.lit('{"p": '), "props", F.lit(', "tags": ["'), "event_type", F.lit('", '), "user_id", F.lit('], "u": '), "user_id", F.lit("}")).alias("doc")), "doc", recursive=True, outer=True).select("event_id", "path", "key", "index", "value")),
                       "WITH e AS (SELECT event_id, replace(props, ' ', '') AS p, json_extract_string(props, '$.k') AS k, event_type AS t, CAST(user_id AS VARCHAR) AS u FROM events) SELECT event_id, x.path, x.key, CAST(x.index AS BIGINT) AS index, x.value FROM e, LATERAL (VALUES ('p', 'p', NULL, p), ('p.k', 'k', NULL, k), ('tags', 'tags', NULL, '[\"' || t || '\",' || u || ']'), ('tags[0]', NULL, 0, '\"' || t || '\"'), ('tags[1]', NULL, 1, u), ('u', 'u', NULL, u)) x(path, key, index, value) WHERE p IS NOT NULL AND t IS NOT NULL AND u IS NOT NULL UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM e WHERE p IS NULL OR t IS NULL OR u IS NULL"),
    "array_agg_json": (plan(lambda t: t.nation.groupBy("n_regionkey").agg(X.array_agg("n_name", ["n_nationkey"]).alias("names"))), "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS names FROM nation GROUP BY 1"),
    "object_agg_json": (plan(lambda t: t.nation.groupBy("n_regionkey").agg(X.object_agg("n_name", "n_nationkey", is_text=False).alias("keys"))), "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY 1"),
    "listagg_ordered": (plan(lambda t: t.nation.groupBy("n_regionkey").agg(X.listagg("n_name", ";", ["n_name"]).alias("names"))), "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "json_get_path": (plan(lambda t: _events(t).select("event_id", "k", X.get("props", "k").alias("same"), X.object_keys("props").alias("keys"), X.parse_json("props").alias("doc"))),
                      "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS same, '[\"k\"]' AS keys, replace(props, ' ', '') AS doc FROM events"),
    "bracket_access": (plan(lambda t: _nested(t).select("event_id", X.get(X.get("doc", "p"), "k").alias("k"), X.get(X.get("doc", "tags"), 0).alias("tag"), X.get(X.get("doc", "tags"), F.col("event_id") % 2 + 1).alias("odd"))),
                       f"SELECT event_id, {_HAS_DOC} json_extract_string(props, '$.k') END AS k, {_HAS_DOC} event_type END AS tag, {_HAS_DOC} CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END END AS odd FROM events"),
    "variant_path": (plan(lambda t: _nested(t).select("event_id", F.try_parse_json("doc").alias("v")).selectExpr("event_id", "v:p.k::bigint AS k", "v:tags[0]::string AS tag", "v:tags[1]::bigint AS user", "v:none.at::string AS missing")),
                     f"SELECT event_id, {_HAS_DOC} {_NUM} END AS k, {_HAS_DOC} event_type END AS tag, {_HAS_DOC} user_id END AS \"user\", CAST(NULL AS VARCHAR) AS missing FROM events"),
    "json_rows": (plan(lambda t: t.nation.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("line"))),
                  "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation"),
    "json_types": (plan(lambda t: t.events.select("event_id", X.typeof("props").alias("t"), X.typeof(X.get_path("props", "k")).alias("kt"), X.typeof("event_type").alias("et"), X.is_object("props").alias("o"), X.is_array("props").alias("a"), X.is_integer(X.get_path("props", "k")).alias("i"), X.is_decimal("event_type").alias("d"), X.is_boolean(F.lit("true")).alias("b"), X.is_null_value(F.lit("null")).alias("n"))),
                   "SELECT event_id, 'OBJECT' AS t, 'INTEGER' AS kt, 'VARCHAR' AS et, true AS o, false AS a, true AS i, false AS d, true AS b, true AS n FROM events WHERE props IS NOT NULL"),
    "json_convert": (plan(lambda t: t.events.select("event_id", X.to_variant("event_type").alias("v"), X.to_array("props").alias("a"), X.to_object("props").alias("o"), X.to_object("event_type").alias("none"), X.try_parse_json("event_type").alias("bad"))),
                     "SELECT event_id, '\"' || event_type || '\"' AS v, '[' || replace(props, ' ', '') || ']' AS a, replace(props, ' ', '') AS o, CAST(NULL AS VARCHAR) AS none, CAST(NULL AS VARCHAR) AS bad FROM events"),
    "array_fns": (plan(lambda t: _baskets(t).select("o_custkey", X.array_size("keys").alias("n"), X.array_slice("keys", 0, 2).alias("head"), X.flatten_array("keys", 1).alias("second"), X.array_size(X.array_cat("keys", "keys")).alias("twice"), X.array_size(X.array_distinct(X.array_cat("keys", "keys"))).alias("once"),
                                                  X.array_contains(X.flatten_array("keys", 0), "keys").alias("has"), X.array_position(X.flatten_array("keys", 0), "keys").cast("long").alias("at"), X.array_size(X.array_append("keys", F.lit(1))).alias("more"), X.flatten_array(X.array_prepend("keys", F.lit("x")), 0).alias("x"), X.array_size(X.array_flatten(X.array_construct("keys", "keys"))).alias("flat"))),
                  f"SELECT o_custkey, len(l) AS n, '[' || array_to_string(l[1:2], ',') || ']' AS head, CAST(l[2] AS VARCHAR) AS second, 2 * len(l) AS twice, len(l) AS once, true AS has, CAST(0 AS BIGINT) AS at, len(l) + 1 AS more, '\"x\"' AS x, 2 * len(l) AS flat FROM {_BASKETS}"),
    "object_fns": (plan(lambda t: t.events.select("event_id", X.object_construct(F.lit("t"), "event_type", F.lit("e"), F.lit(None).cast("string")).alias("made"), X.object_construct_keep_null(F.lit("e"), F.lit(None).cast("string")).alias("kept"), X.object_insert("props", F.lit("z"), F.lit(1)).alias("more"), X.object_delete("props", "k").alias("less"), X.object_pick("props", "k", "q").alias("some"))),
                   "SELECT event_id, '{\"t\":\"' || event_type || '\"}' AS made, '{\"e\":null}' AS kept, replace(replace(props, ' ', ''), '}', ',\"z\":1}') AS more, CASE WHEN props IS NOT NULL THEN '{}' END AS less, replace(props, ' ', '') AS some FROM events"),
    "string_fns": (plan(_strings), "SELECT p_partkey, '[\"' || replace(p_name, ' ', '\",\"') || '\"]' AS words, string_split(p_name, ' ')[2] AS second, instr(p_name, 'a') AS at, reverse(p_name) AS back, lpad(p_name, 12, '*') AS left, rpad(p_brand, 12, '.') AS right, replace(translate(p_name, 'ab', '12'), 'c', '') AS swapped, contains(p_name, 're') AS has, starts_with(p_brand, 'Brand') AS starts, ends_with(p_name, 'n') AS ends, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part"),
    "regex_fns": (plan(lambda t: t.part.select("p_partkey", X.regexp_like("p_type", "A.*D").alias("found"), X.regexp_substr("p_brand", "[0-9]+").alias("digits"), X.regexp_replace("p_type", "[AEIOU]", "_").alias("masked"), X.regexp_count("p_type", "[AEIOU]").alias("vowels"))),
                  "SELECT p_partkey, regexp_matches(p_type, 'A.*D') AS found, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS digits, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked, len(regexp_extract_all(p_type, '[AEIOU]')) AS vowels FROM part"),
    "date_fns": (plan(_dates), "SELECT o_orderkey, CAST(d + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(d - INTERVAL 10 DAY AS DATE) AS before, date_diff('month', d, DATE '1998-12-31') AS months, date_sub('day', d, DATE '1998-12-31') AS days, date_diff('year', d, DATE '1998-12-31') AS years, last_day(d) AS month_end, strftime(d, '%a') AS weekday, strftime(d, '%b') AS month, CAST(date_trunc('month', d) AS DATE) AS month_start, year(d) AS y FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)"),
    "conditional_fns": (plan(_conditions), "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS positive, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE '-' END AS rich, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '?' END AS segment, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS z, nullif(c_nationkey, 0) AS nz FROM customer"),
    "numeric_fns": (plan(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", X.div0("l_extendedprice", F.col("l_linenumber") - 1).alias("d0"), X.div0null("l_extendedprice", F.col("l_linenumber") - 1).alias("dn"), X.truncate("l_quantity", -1).alias("tens"), F.ceil("l_discount").cast("long").alias("up"))),
                    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_extendedprice / (l_linenumber - 1) END AS d0, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice / (l_linenumber - 1) END AS dn, floor(l_quantity / 10) * 10 AS tens, CAST(ceil(l_discount) AS BIGINT) AS up FROM lineitem"),
    "hash_fns": (plan(lambda t: t.customer.select("c_custkey", X.sha1("c_name").alias("h1"), X.sha2("c_name").alias("h2"))), "SELECT c_custkey, sha1(c_name) AS h1, sha256(c_name) AS h2 FROM customer"),
    "try_fns": (plan(lambda t: t.events.select("event_id", X.try_to_number(X.get_path("props", "k")).alias("n"), X.try_to_number("event_type").alias("bad"), X.try_to_boolean(F.when(F.col("event_type") == "click", "yes").otherwise("maybe")).alias("b"), X.try_to_date(F.date_format("ts", "dd/MM/yyyy")).alias("d"), X.try_to_date("event_type").alias("none"))),
                f"SELECT event_id, CAST({_NUM} AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS bad, CASE WHEN event_type = 'click' THEN true END AS b, CAST(ts AS DATE) AS d, CAST(NULL AS DATE) AS none FROM events"),
    "timestamp_fns": (plan(lambda t: t.events.select("event_id", *(X.dateadd(u, n, F.col("ts").cast("timestamp_ntz"), False).alias(f"add_{u}") for u, n in (("ss", 90), ("ms", 1500), ("us", -7), ("hour", 5), ("mon", 1))), X.datediff("ms", F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")), F.col("ts").cast("timestamp_ntz")).alias("since"))),
                      "SELECT event_id, t + INTERVAL 90 SECOND AS add_ss, t + INTERVAL 1500 MILLISECOND AS add_ms, t - INTERVAL 7 MICROSECOND AS add_us, t + INTERVAL 5 HOUR AS add_hour, t + INTERVAL 1 MONTH AS add_mon, (epoch_us(t) - epoch_us(TIMESTAMP '2020-01-01')) // 1000 AS since FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM events)"),
    "convert_fns": (plan(lambda t: t.orders.select("o_orderkey", X.to_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d"), X.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).cast("string").alias("s"), X.to_json("o_custkey", False).alias("j"), X.array_construct_compact("o_custkey", F.nullif("o_orderstatus", F.lit("O"))).alias("a"), X.get(X.array_construct("o_orderkey", "o_custkey"), 1).alias("second"))),
                    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s, CAST(o_custkey AS VARCHAR) AS j, CASE WHEN o_orderstatus = 'O' THEN '[' || o_custkey || ']' ELSE '[' || o_custkey || ',\"' || o_orderstatus || '\"]' END AS a, CAST(o_custkey AS VARCHAR) AS second FROM orders"),
    "sample_rows": (plan(lambda t: O.sample_rows(t.lineitem, 100, seed=3).agg(F.count("*").alias("n"))), "SELECT 100 AS n"),
    "sample_percent": (plan(lambda t: O.sample_percent(t.lineitem, 10, seed=3).agg(F.count("*").alias("k")).crossJoin(t.lineitem.agg(F.count("*").alias("n"))).select(F.expr("k between 0.07 * n and 0.13 * n").alias("near"))), "SELECT true AS near"),
}
