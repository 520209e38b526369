"""Every registered query of the relational part against its DuckDB text, on the smallest tables."""

import os

import duckdb
import pytest

from phenoquarry import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "part orders lineitem events".split()
QUERIES, SQL = plans.QUERIES, plans.ORACLE_SQL


def _plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return round(float(v), 5) + 0.0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert sorted(names) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_whole(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
