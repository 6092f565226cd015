"""Every registered query against its check SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from maskweave.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or hasattr(v, "as_tuple") else v


def rows(names, order, data):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    sql = entry.oracle_sql()
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert name in sql
    want = duck.execute(sql[name])
    names = [c[0] for c in want.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert rows(df.columns, order, got) == rows(names, order, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
