"""Statements that change tables, each over a whole table; the result is the table after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import register
from ..sources import copy_into, create_stage, drop_stage
from ..warehouse import Warehouse


def _on(name: str, act):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        w = Warehouse(spark)
        w.attach(f"t_{name}", spark.read.parquet(f"{folder}/{name}.parquet"))
        return act(w, f"t_{name}", lambda other: spark.read.parquet(f"{folder}/{other}.parquet"))

    return run


def _update(w, t, _):
    w.update(t, {"c_acctbal": "c_acctbal * 2", "c_mktsegment": "'NONE'"}, "c_nationkey < 5")
    return w.table(t).select("c_custkey", "c_acctbal", "c_mktsegment")


def _delete(w, t, _):
    w.delete(t, "c_acctbal < 0")
    return w.table(t).select("c_custkey", "c_acctbal")


def _merge(w, t, read):
    source = read("customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(10_000_000)).alias("c_custkey"), "c_name", "c_acctbal")
    w.merge(t, source, ["c_custkey"], update={"c_acctbal": "t.c_acctbal + 1"}, insert={"c_custkey": "s.c_custkey", "c_name": "s.c_name", "c_acctbal": "s.c_acctbal"}, delete_if="s.c_acctbal < 0")
    return w.table(t).select("c_custkey", "c_name", "c_acctbal", "c_nationkey")


def _ctas(w, t, _):
    w.create_table("sums", w.spark.sql(f"SELECT o_orderstatus, count(*) AS n FROM {t} GROUP BY 1"))
    w.create_table("nothing", w.table("sums").where("false"))
    return w.table("sums").unionByName(w.table("nothing"))


def _alter(w, t, _):
    w.add_column(t, "note", "string")
    w.rename_column(t, "n_name", "name")
    w.drop_column(t, "n_regionkey")
    w.rename_table(t, "countries")
    return w.table("countries")


def _insert(w, t, read):
    w.insert(t, read("supplier").select(F.col("s_suppkey") + 1_000_000, "s_name"), ["c_custkey", "c_name"])
    return w.table(t).select("c_custkey", "c_name", "c_nationkey")


def _rollback(w, t, _):
    w.begin()
    w.update(t, {"n_name": "'gone'"})
    w.truncate(t)
    w.rollback()
    return w.table(t).select("n_nationkey", "n_name")


def _truncate(w, t, _):
    w.truncate(t)
    return w.table(t).agg(F.count("*").alias("n"))


def _copy(w, t, _):
    folder = f"{w.root}/csv"
    w.table(t).select("n_nationkey", "n_name").coalesce(2).write.option("header", True).csv(folder)
    create_stage(w, "files", folder)
    w.create_table("loaded", "n_nationkey int, n_name string")
    copy_into(w, "loaded", "files", skip_header=1)
    return w.table("loaded")


def _sequence(w, t, _):
    w.create_sequence("s", 100, 10)
    return w.with_sequence(w.table(t).select("c_custkey"), "s", "number", ["c_custkey"])


def _view(w, t, _):
    w.create_view("rich", f"SELECT c_custkey, c_acctbal FROM {t} WHERE c_acctbal > 5000")
    return w.spark.sql("SELECT c_custkey FROM rich WHERE c_acctbal < 9000")


def _function(w, t, _):
    w.create_function("with_tax", "x DOUBLE, rate DOUBLE", "DOUBLE", "x * (1 + rate)")
    return w.spark.sql(f"SELECT l_orderkey, l_linenumber, with_tax(l_extendedprice, l_tax) AS total FROM {t}")


def _dynamic(w, t, _):
    w.create_dynamic_table("per_segment", f"SELECT c_mktsegment, count(*) AS n FROM {t} GROUP BY 1")
    w.delete(t, "c_nationkey >= 10")
    return w.refresh("per_segment")


def _metadata(w, t, _):
    w.information_schema()
    return w.spark.sql(f"SELECT column_name, data_type, CAST(ordinal_position AS BIGINT) AS position FROM information_schema_columns WHERE table_name = '{t}'")


def _context(w, t, _):
    w.use(schema="RAW")
    return w.table(t).select("r_regionkey", *w.context_columns().values())


def _describe(w, t, _):
    return w.describe(t).select("name", "type", "kind")


def _show(w, t, _):
    w.create_view("small", f"SELECT * FROM {t} WHERE n_nationkey < 3")
    return w.show_tables().select("name", "database_name", "schema_name", "kind")


def _databases(w, t, read):
    """A database for each region, a schema for each of its nations; one of them is dropped."""
    for r in w.table(t).orderBy("r_regionkey").collect():
        w.create_database(r.r_name)
        w.use(database=r.r_name)
        for n in read("nation").where(F.col("n_regionkey") == r.r_regionkey).collect():
            w.create_schema(n.n_name)
        w.drop_schema("PUBLIC")
    w.drop_database("ASIA")
    return w.show_schemas().where("database_name <> 'EMULATOR_DB'")


def _iceberg(w, t, _):
    w.create_table("lake", w.table(t).where("n_nationkey < 5"), kind="ICEBERG TABLE")
    w.insert("lake", w.table(t).where("n_nationkey >= 20"))
    return w.table("lake").join(w.show_tables().where("name = 'lake'").select("kind", "is_iceberg"), how="cross").select("n_nationkey", "n_name", "kind", "is_iceberg")


def _drop_function(w, t, _):
    w.create_function("grade", "x DOUBLE", "STRING", "'none'")
    w.drop_function("grade")
    w.drop_function("grade", if_exists=True)
    w.create_function("grade", "x DOUBLE", "STRING", "CASE WHEN x > 5000 THEN 'high' WHEN x > 0 THEN 'low' END")
    return w.spark.sql(f"SELECT c_custkey, grade(c_acctbal) AS grade FROM {t}")


def _drop_stage(w, t, _):
    for part, condition in (("a", "s_suppkey % 2 = 0"), ("b", "s_suppkey % 2 = 1")):
        w.table(t).where(condition).select("s_suppkey", "s_name", "s_acctbal").write.parquet(f"{w.root}/{part}")
    create_stage(w, "files", f"{w.root}/a")
    w.create_table("loaded", w.table(t).select("s_suppkey", "s_name", "s_acctbal").where("false"))
    copy_into(w, "loaded", "files", file_format="parquet")
    drop_stage(w, "files")
    create_stage(w, "files", f"{w.root}/b", or_replace=False)
    copy_into(w, "loaded", "files", file_format="parquet")
    return w.table("loaded")


def _sql_functions(w, t, _):
    register(w.spark)
    return w.spark.sql(f"SELECT event_id, get_path(props, 'k') AS k, object_keys(props) AS keys, is_object(props) AS o, div0(value, event_id % 3) AS d, strtok(event_type, 'ae', 1) AS s, array_cat(to_array(props), '[1]') AS a FROM {t}")


#: name -> (plan, SQL)
STATEMENTS = {
    "dml_update": (_on("customer", _update), "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey < 5 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_delete": (_on("customer", _delete), "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, false)"),
    "dml_merge": (_on("customer", _merge), "WITH s AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10000000 END AS c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT t.c_custkey, t.c_name, CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE t.c_acctbal + 1 END AS c_acctbal, t.c_nationkey FROM customer t LEFT JOIN s ON t.c_custkey = s.c_custkey WHERE s.c_custkey IS NULL OR NOT s.c_acctbal < 0 UNION ALL SELECT s.c_custkey, s.c_name, s.c_acctbal, NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_custkey = s.c_custkey)"),
    "dml_insert": (_on("customer", _insert), "SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier"),
    "dml_truncate": (_on("nation", _truncate), "SELECT 0 AS n"),
    "ddl_ctas": (_on("orders", _ctas), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "ddl_alter": (_on("nation", _alter), "SELECT n_nationkey, n_name AS name, CAST(NULL AS VARCHAR) AS note FROM nation"),
    "tx_rollback": (_on("nation", _rollback), "SELECT n_nationkey, n_name FROM nation"),
    "copy_into": (_on("nation", _copy), "SELECT n_nationkey, n_name FROM nation"),
    "sequence": (_on("customer", _sequence), "SELECT c_custkey, 100 + 10 * (row_number() OVER (ORDER BY c_custkey) - 1) AS number FROM customer"),
    "view": (_on("customer", _view), "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_acctbal < 9000"),
    "sql_udf": (_on("lineitem", _function), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 + l_tax) AS total FROM lineitem"),
    "dynamic_table": (_on("customer", _dynamic), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT coalesce(c_nationkey >= 10, false) GROUP BY 1"),
    "information_schema": (_on("nation", _metadata), "SELECT * FROM (VALUES ('n_nationkey', 'NUMBER(38,0)', CAST(1 AS BIGINT)), ('n_name', 'VARCHAR(16777216)', 2), ('n_regionkey', 'NUMBER(38,0)', 3)) v(column_name, data_type, position)"),
    "context_fns": (_on("region", _context), "SELECT r_regionkey, 'EMULATOR_USER' AS \"current_user\", 'ACCOUNTADMIN' AS \"current_role\", 'EMULATOR_DB' AS \"current_database\", 'RAW' AS \"current_schema\", 'EMULATOR_WH' AS \"current_warehouse\" FROM region"),
    "describe": (_on("nation", _describe), "SELECT * FROM (VALUES ('n_nationkey', 'NUMBER(38,0)', 'COLUMN'), ('n_name', 'VARCHAR(16777216)', 'COLUMN'), ('n_regionkey', 'NUMBER(38,0)', 'COLUMN')) v(name, type, kind)"),
    "show_tables": (_on("nation", _show), "SELECT * FROM (VALUES ('t_nation', 'EMULATOR_DB', 'PUBLIC', 'TABLE'), ('small', 'EMULATOR_DB', 'PUBLIC', 'VIEW')) v(name, database_name, schema_name, kind)"),
    "databases": (_on("region", _databases), "SELECT r_name AS database_name, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"),
    "iceberg_table": (_on("nation", _iceberg), "SELECT n_nationkey, n_name, 'ICEBERG TABLE' AS kind, 'Y' AS is_iceberg FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20"),
    "drop_function": (_on("customer", _drop_function), "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' END AS grade FROM customer"),
    "drop_stage": (_on("supplier", _drop_stage), "SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "sql_functions": (_on("events", _sql_functions), "SELECT event_id, json_extract_string(props, '$.k') AS k, '[\"k\"]' AS keys, true AS o, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value / (event_id % 3) END AS d, list_filter(regexp_split_to_array(event_type, '[ae]'), lambda x: x <> '')[1] AS s, '[' || replace(props, ' ', '') || ',1]' AS a FROM events"),
}
