"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from millrace.plans import ALL


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if hasattr(v, "year"):
        return str(v)[:19].removesuffix(" 00:00:00")
    return repr(round(float(v), 6)) if not isinstance(v, (str, bool)) else str(v)


def normal(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf, oracle, name):
    run, sql = ALL[name]
    got = normal(run(spark, sf).toPandas())
    assert got
    assert got == normal(oracle.execute(sql).df())


def test_entry_registers_every_query(spark):
    import __spark_entry__

    assert set(ALL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
