"""The corpus pipeline: each stage on what the one before kept, and edge cases."""

import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline as cp
from millrace.llm import decontamination, near_duplicates, quality_rules, queries
from millrace.llm._store import new_folder, remove_folders, saved


def test_stages_and_run(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in cp.STAGES:
        kept.append(saved(stage(spark, kept[-1], sf), f"test-{name}"))
    assert all(d.columns == columns for d in kept[:-1]) and kept[-1].columns[: len(columns)] == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] == {r.doc_id for r in quality_rules.rate(kept[0]).where("kept").collect()}
    components = {r.doc_id: r.component_id for r in near_duplicates.components_of(kept[1]).collect()}
    assert ids[2] == set(components.values())
    bad = {r.doc_id for r in decontamination.overlaps(kept[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - bad and ids[4] <= ids[3] and ids[5] == ids[4]
    assert kept[5].count() == kept[4].count()
    out = cp.run(spark, sf)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in kept[5].select("doc_id").collect())


def test_stages_of_odd_and_empty_tables(spark, sf, odd, none):
    for _, stage in cp.STAGES:
        assert stage(spark, odd, sf).columns[: len(odd.columns)] == odd.columns
        assert stage(spark, none, sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    cells = lambda df: sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in r) for r in df.itertuples(index=False)), key=str)
    assert cells(got) == cells(want) and len(got)


def test_entry_has_every_operator_and_the_pipeline():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_folders_are_removed(spark):
    kept = saved(spark.range(3), "kept")
    path = new_folder(spark, "unused")
    assert kept.count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir")) and remove_folders(spark) >= 1
    with pytest.raises(Exception):
        kept.collect()
