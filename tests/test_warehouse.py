"""Statements on tables: goldens of upserts, updates, columns, snapshots, stages and metadata."""

import pytest

from millrace.sources import copy_into, create_stage, drop_stage
from millrace.warehouse import Warehouse, WarehouseError


@pytest.fixture
def w(spark):
    return Warehouse(spark)


def make(w, name, values, schema):
    return w.create_table(name, w.spark.createDataFrame(values, schema), or_replace=True)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge(w):
    make(w, "target", [(1, "old1"), (2, "old2"), (None, "x")], "id int, value string")
    source = w.spark.createDataFrame([(1, "updated1"), (3, "new3"), (None, "n")], "id int, value string")
    assert w.merge("target", source, ["id"], update={"value": "s.value"}, insert={"id": "s.id", "value": "s.value"}) == {"inserted": 2, "updated": 1, "deleted": 0}
    assert rows(w.table("target")) == [(1, "updated1"), (2, "old2"), (3, "new3"), (None, "n"), (None, "x")]
    assert w.merge("target", source, ["id"], delete_if="s.value = 'new3'") == {"inserted": 0, "updated": 0, "deleted": 1}
    with pytest.raises(WarehouseError):
        w.merge("target", source.union(source), ["id"], update={"value": "s.value"})


def test_update_and_delete_keep_rows_of_unknown_condition(w):
    make(w, "t", [(1, "active", 100), (2, "inactive", 200), (3, None, 300)], "id int, status string, amount int")
    assert w.update("t", {"amount": "amount + 1"}, "status = 'active'") == 1
    assert rows(w.table("t")) == [(1, "active", 101), (2, "inactive", 200), (3, None, 300)]
    assert w.delete("t", "status = 'inactive'") == 1
    assert rows(w.table("t")) == [(1, "active", 101), (3, None, 300)]
    assert w.update("t", {"amount": "0"}) == 2
    with pytest.raises(WarehouseError):
        w.update("t", {"nothing": "0"})


def test_insert_truncate_and_columns(w):
    w.create_table("t", "id int, name string")
    assert w.insert("t", w.spark.createDataFrame([(1,)], "x int"), ["id"]) == 1
    w.add_column("t", "extra", "bigint")
    w.rename_column("t", "name", "label")
    assert w.table("t").columns == ["id", "label", "extra"] and rows(w.table("t")) == [(1, None, None)]
    w.drop_column("t", "extra")
    w.rename_table("t", "u")
    with pytest.raises(WarehouseError):
        w.table("t")
    w.truncate("u")
    assert w.table("u").count() == 0
    w.insert("u", w.spark.createDataFrame([(2, "b")], "a int, b string"))
    assert w.spark.sql("SELECT label FROM u WHERE id = 2").first()[0] == "b"


def test_create_and_drop(w):
    make(w, "t", [(1,)], "id int")
    with pytest.raises(WarehouseError):
        w.create_table("t", "id int")
    w.create_table("t", "id int", if_not_exists=True)
    assert w.table("t").count() == 1
    assert w.create_table("none", w.table("t").where("false")).columns == ["id"]
    w.drop_table("t")
    w.drop_table("t", if_exists=True)
    with pytest.raises(WarehouseError):
        w.drop_table("t")


def test_transactions(w):
    make(w, "t", [(1, 100)], "id int, value int")
    w.begin()
    with pytest.raises(WarehouseError):
        w.begin()
    w.update("t", {"value": "999"})
    w.create_table("inside", "id int")
    w.rollback()
    assert rows(w.table("t")) == [(1, 100)] and "inside" not in w.tables
    w.begin()
    w.delete("t")
    w.commit()
    w.rollback()
    assert w.table("t").count() == 0


def test_sequences(w):
    w.create_sequence("s")
    assert [w.nextval("s"), w.nextval("s"), w.currval("s")] == [1, 2, 2]
    w.create_sequence("b", 100, 10)
    assert [w.nextval("b"), w.nextval("b")] == [100, 110]
    out = w.with_sequence(w.spark.range(50), "b", "n", ["id"])
    assert rows(out) == sorted(((i, 120 + 10 * i) for i in range(50)), key=str) and w.nextval("b") == 620


def test_views_functions_and_dynamic_tables(w):
    make(w, "base", [(1, 10), (2, 20)], "id int, value int")
    w.create_view("doubled", "SELECT id, value * 2 AS doubled FROM base")
    assert w.spark.sql("SELECT doubled FROM doubled WHERE id = 1").first()[0] == 20
    w.drop_view("doubled")
    w.create_function("add_one", "x INT", "INT", "x + 1")
    assert w.spark.sql("SELECT add_one(add_one(4))").first()[0] == 6
    w.drop_function("add_one")
    w.create_dynamic_table("total", "SELECT sum(value) AS v FROM base")
    w.delete("base", "id = 2")
    assert (w.table("total").first()[0], w.refresh("total").first()[0]) == (30, 10)


def test_copy_into(w, tmp_path):
    (tmp_path / "a.csv").write_text("ID,NAME\n1,Alice\n2,\"Bob, Jr\"\n")
    (tmp_path / "b.csv").write_text("ID,NAME\n3,Carol\n")
    (tmp_path / "c.txt").write_text("no\n")
    w.create_table("t", "id int, name string")
    create_stage(w, "st", f"file://{tmp_path}")
    assert copy_into(w, "t", "st", skip_header=1) == {"rows_loaded": 3, "files_loaded": 2}
    assert rows(w.table("t")) == [(1, "Alice"), (2, "Bob, Jr"), (3, "Carol")]
    w.truncate("t")
    assert copy_into(w, "t", "st", file="a.csv", skip_header=2) == {"rows_loaded": 1, "files_loaded": 1}
    for stage, table in (("none", "t"), ("st", "none")):
        with pytest.raises(WarehouseError):
            copy_into(w, table, stage)
    drop_stage(w, "st")
    with pytest.raises(WarehouseError):
        drop_stage(w, "st")


def test_names_and_metadata(w):
    make(w, "t", [(1, "a")], "id int, name string")
    w.create_database("sales")
    w.use(database="sales", schema="PUBLIC")
    w.create_schema("raw")
    assert {r[0] for r in w.show_databases().collect()} == {"EMULATOR_DB", "sales"} and ("sales", "raw") in {tuple(r) for r in w.show_schemas().collect()}
    with pytest.raises(WarehouseError):
        w.create_database("sales")
    w.drop_schema("raw")
    w.drop_database("sales")
    assert rows(w.describe("t")) == [("id", "NUMBER(38,0)", "COLUMN", "Y"), ("name", "VARCHAR(16777216)", "COLUMN", "Y")]
    assert "t" in {r.name for r in w.show_tables().collect()}
    w.information_schema()
    assert w.spark.sql("SELECT count(*) FROM information_schema_columns WHERE table_name = 't'").first()[0] == 2


def test_appends_write_only_new_rows_and_column_changes_write_nothing(w):
    make(w, "t", [(1, "a")], "id int, name string")
    first = w.tables["t"].parts
    assert w.insert("t", w.spark.createDataFrame([(2, "b"), (3, "c")], "id int, name string")) == 2
    assert w.tables["t"].parts[:1] == first and len(w.tables["t"].parts) == 2
    w.drop_column("t", "name")
    w.add_column("t", "name", "string")
    assert not w.tables["t"].parts and rows(w.table("t")) == [(1, None), (2, None), (3, None)]
    assert w.insert("t", w.table("t").select("id"), ["id"]) == 3
    assert w.insert("t", w.spark.createDataFrame([], "x int"), ["id"]) == 0
    assert w.delete("t", "id = 3") == 2 and rows(w.table("t")) == [(1, None), (1, None), (2, None), (2, None)]
    w.insert("t", w.spark.createDataFrame([(9, "z")], "id int, name string"))
    w.compact("t")
    assert len(w.tables["t"].parts) == 1 and w.table("t").count() == 5


def test_an_attached_table_stays_as_it_is(w, tmp_path):
    w.spark.range(3).write.parquet(f"{tmp_path}/t")
    w.attach("t", w.spark.read.parquet(f"{tmp_path}/t"))
    w.begin()
    assert w.insert("t", w.spark.range(2)) == 2 and w.table("t").count() == 5
    w.rollback()
    assert w.table("t").count() == 3 and w.spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_merge_writes_once(w):
    make(w, "t", [(1, "a"), (2, "b"), (3, "c")], "id int, value string")
    source = w.spark.createDataFrame([(1, "x"), (2, "y"), (8, "n"), (9, "m"), (9, "m")], "id int, value string")
    n = w.merge("t", source, ["id"], update={"value": "s.value"}, insert={"id": "s.id", "value": "s.value"}, delete_if="s.value = 'y'", insert_if="s.id = 9")
    assert n == {"inserted": 2, "updated": 1, "deleted": 1}  # source rows that repeat and match nothing are no error
    assert rows(w.table("t")) == [(1, "x"), (3, "c"), (9, "m"), (9, "m")] and w.table("t").columns == ["id", "value"]
    assert w.insert("t", source.where("id = 8")) == 1 and w.table("t").count() == 5
