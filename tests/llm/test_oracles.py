"""Queries with SQL of their own give what that SQL gives, on the smallest tables."""

import os

import pytest

from maskmetrics.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "clicks"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r) for r in got.select(columns).collect()) == rows(want.fetchall())
