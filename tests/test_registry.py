"""Registered queries against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__
from gistmill import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert len(at) == len(res.description)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    registry.queries()[name](spark, DATA).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
