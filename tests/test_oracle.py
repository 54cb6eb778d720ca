"""Every registered query against its SQL counterpart on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402
from checks.oracle import ORACLES  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def lines(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in data)


ORDERS = {
    "tag_selection": ["plc_id", "tag_name"], "logged_plcs": ["name"], "health_plcs": ["name"], "pending_partitions": ["partition_start"],
    "pending_uploads": ["plc_id"], "sibling_order": ["plc_id", "parent", "is_leaf", "name", "tag_id"], "latest_n": ["-id"],
}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_row_order(spark, name):
    """Where order is the point of an operator, its rows come in it."""
    frame = QUERIES[name](spark, SF)
    found = [r.asDict() for r in frame.collect()]
    key = lambda r: tuple(-r[k[1:]] if k[0] == "-" else r[k] for k in ORDERS[name])
    assert len(found) > 1 and found == sorted(found, key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = driver.queries()[name](spark, SF)
    result = duck.execute(driver.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in result.description}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in frame.schema} == types
    assert lines(frame.columns, [tuple(r) for r in frame.collect()]) == lines(list(types), result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 120
