"""Queries with check SQL, against it, on the smallest tables."""

import duckdb
import pytest

from maskweave.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SAMPLE, needs_data
from tests.test_queries import TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLE}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SAMPLE)
    want = duck.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    found = rows(df.columns, order, df.collect())
    assert found and found == rows(names, order, want.fetchall())
