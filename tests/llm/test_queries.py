"""Registered corpus queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    assert sorted(frame.columns) == columns
    wanted = [dict(zip([c[0] for c in result.description], row)) for row in result.fetchall()]
    assert sorted(repr([r[c] for c in columns]) for r in wanted) == sorted(repr([r[c] for c in columns]) for r in frame.collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    rows = {"op9_url_filter": "pages", "op3_license_scan": None}.get(name, "documents")
    assert frame.count() == (spark.read.parquet(f"{SF}/{rows}.parquet").count() if rows else frame.count())
