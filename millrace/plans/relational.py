"""Selection, joins, aggregates, windows, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ._tables import plan


def _money(x):
    return F.round(x, 2)


def _q1(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        _money(F.sum("l_quantity")).alias("sum_qty"), _money(F.sum("l_extendedprice")).alias("sum_base"), _money(F.sum(price)).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def _by_customer(t):
    return W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_ORDER_KEYS = ("o_custkey", "o_orderkey")
_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"

#: name -> (plan, SQL)
RELATIONAL = {
    "filter_project": (plan(lambda t: t.lineitem.where((F.col("l_discount").between(0.05, 0.07)) & (F.col("l_quantity") < 24) & F.col("l_returnflag").isin("A", "R") & ~F.col("l_linestatus").like("X%"))
                            .select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))),
                       "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R') AND l_linestatus NOT LIKE 'X%'"),
    "pricing_summary": (plan(_q1), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "case_when": (plan(lambda t: t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low").alias("band"))),
                  "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders"),
    "cast_arithmetic": (plan(lambda t: t.part.select("p_partkey", F.col("p_size").cast("string").alias("size_text"), (F.col("p_size") % 7).cast("long").alias("rest"), F.floor("p_retailprice").cast("long").alias("whole"))),
                        "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, CAST(p_size % 7 AS BIGINT) AS rest, CAST(floor(p_retailprice) AS BIGINT) AS whole FROM part"),
    "cte_subquery": (plan(lambda t: (lambda sums: sums.join(sums.agg(F.avg("total").alias("mean")), F.col("total") > F.col("mean")).select("o_custkey", _money("total").alias("total")))(t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")))),
                     "WITH sums AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, round(total, 2) AS total FROM sums WHERE total > (SELECT avg(total) FROM sums)"),
    "exists_correlated": (plan(lambda t: t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")),
                          "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "join_inner": (plan(lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
                        .groupBy("r_name", "n_name").agg(F.count("*").alias("n"), _money(F.sum("o_totalprice")).alias("total"))),
                   "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "join_left": (plan(lambda t: t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))),
                  "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "join_right": (plan(lambda t: t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))),
                   "SELECT c_custkey, count(o_orderkey) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey"),
    "join_full": (plan(lambda t: t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")).join(t.customer.where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers")), "k", "full")),
                  "SELECT coalesce(s.k, c.k) AS k, suppliers, customers FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) c ON s.k = c.k"),
    "join_anti": (plan(lambda t: t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")),
                  "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "join_cross": (plan(lambda t: t.region.crossJoin(t.nation.select("n_name"))), "SELECT r_regionkey, r_name, n_name FROM region CROSS JOIN nation"),
    "join_theta": (plan(lambda t: t.nation.join(t.region, F.col("n_regionkey") < F.col("r_regionkey")).select("n_nationkey", "r_regionkey")), "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "join_using": (plan(lambda t: t.customer.select(F.col("c_nationkey").alias("k"), "c_acctbal").join(t.supplier.select(F.col("s_nationkey").alias("k")).distinct(), "k").groupBy("k").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("most"))),
                   "SELECT k, count(*) AS n, max(c_acctbal) AS most FROM (SELECT c_nationkey AS k, c_acctbal FROM customer) c JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s USING (k) GROUP BY k"),
    "join_natural": (plan(lambda t: t.spark.sql("SELECT r_name, n_name FROM {n} NATURAL JOIN {r}", n=t.nation.select("n_name", F.col("n_regionkey").alias("k")), r=t.region.select(F.col("r_regionkey").alias("k"), "r_name"))),
                     "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "values_join": (plan(lambda t: t.orders.join(t.spark.sql("SELECT * FROM VALUES ('F', 'filled'), ('O', 'open') AS v(o_orderstatus, label)"), "o_orderstatus", "left").groupBy("o_orderstatus", "label").agg(F.count("*").alias("n"))),
                    "SELECT o_orderstatus, label, count(*) AS n FROM orders LEFT JOIN (VALUES ('F', 'filled'), ('O', 'open')) v(o_orderstatus, label) USING (o_orderstatus) GROUP BY 1, 2"),
    "agg_distinct": (plan(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").alias("first"), F.max("l_quantity").alias("most"))),
                     "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first, max(l_quantity) AS most FROM lineitem GROUP BY 1"),
    "agg_having": (plan(lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15"),
    "agg_rollup": (plan(lambda t: t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))),
                   "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "agg_cube": (plan(lambda t: t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "agg_grouping_sets": (plan(lambda t: t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))),
                          "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "agg_statistics": (plan(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev("l_quantity"), 4).alias("sd"), F.round(F.var_pop("l_quantity"), 4).alias("var"), F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("corr"), F.median("l_quantity").alias("median"))),
                       "SELECT l_returnflag, round(stddev(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS var, round(corr(l_quantity, l_extendedprice), 4) AS corr, median(l_quantity) AS median FROM lineitem GROUP BY 1"),
    "agg_approx_distinct": (plan(lambda t: t.lineitem.agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) / F.count_distinct("l_partkey") - 1) < 0.1).alias("near"))), "SELECT true AS near"),
    "win_rank": (plan(lambda t: (lambda w: t.orders.select(*_ORDER_KEYS, F.row_number().over(w).cast("long").alias("rn"), F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long").alias("rk"), F.dense_rank().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long").alias("dr")))(_by_customer(t))),
                 f"SELECT o_custkey, o_orderkey, row_number() OVER {_W} AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders"),
    "win_lag_lead": (plan(lambda t: (lambda w: t.orders.select(*_ORDER_KEYS, F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2).over(w).alias("after")))(_by_customer(t))),
                     f"SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER {_W} AS before, lead(o_totalprice, 2) OVER {_W} AS after FROM orders"),
    "win_frames": (plan(lambda t: (lambda w: t.orders.select(*_ORDER_KEYS, F.count("*").over(w.rowsBetween(-2, 1)).alias("near"), F.max("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("most"), _money(F.sum("o_totalprice").over(W.partitionBy("o_custkey"))).alias("total")))(_by_customer(t))),
                   f"SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders"),
    "win_range_frame": (plan(lambda t: t.part.select("p_partkey", F.count("*").over(W.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("near"))),
                        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part"),
    "win_first_last_nth": (plan(lambda t: (lambda w: t.orders.select(*_ORDER_KEYS, F.first("o_totalprice").over(w).alias("first"), F.last("o_totalprice").over(w).alias("last"), F.nth_value("o_totalprice", 2).over(w).alias("second")))(_by_customer(t).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))),
                           "SELECT o_custkey, o_orderkey, first_value(o_totalprice) OVER w AS first, last_value(o_totalprice) OVER w AS last, nth_value(o_totalprice, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "win_ntile_pct": (plan(lambda t: (lambda w: t.orders.select(*_ORDER_KEYS, F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd")))(_by_customer(t))),
                      f"SELECT o_custkey, o_orderkey, ntile(4) OVER {_W} AS quarter, round(percent_rank() OVER {_W}, 6) AS pr, round(cume_dist() OVER {_W}, 6) AS cd FROM orders"),
    "set_union": (plan(lambda t: t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_union_all": (plan(lambda t: t.customer.select(F.col("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "set_intersect": (plan(lambda t: t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))), "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "set_intersect_all": (plan(lambda t: t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))), "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "set_except": (plan(lambda t: t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_totalprice > 300000").select("o_custkey"))), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000"),
    "set_except_all": (plan(lambda t: t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))), "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "distinct": (plan(lambda t: t.lineitem.select("l_returnflag", "l_linestatus").distinct()), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "limit_offset": (plan(lambda t: t.nation.orderBy(F.col("n_name").asc_nulls_last(), "n_nationkey").offset(5).limit(10).select("n_name", "n_nationkey")), "SELECT n_name, n_nationkey FROM nation ORDER BY n_name ASC NULLS LAST, n_nationkey LIMIT 10 OFFSET 5"),
    "topk": (plan(lambda t: t.orders.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20"),
}
