"""Every query with a SQL twin against DuckDB over the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
NAMES = sorted(entry.oracle_sql())


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_like_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
