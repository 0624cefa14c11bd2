"""Every registered query of the engine against its SQL, on the smallest data; and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.plans import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(engine.QUERIES))
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in engine.SQL:
        assert rows or name.startswith("synthetic")
        return
    want = duck.sql(engine.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    pick = lambda names, r: tuple(cell(r[names.index(c)]) for c in columns)
    assert sorted(pick(df.columns, r) for r in rows) == sorted(pick(want.columns, r) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
