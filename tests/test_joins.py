"""Joins and ordered work with a hot key, on every path they can take."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import joins, shards


@pytest.fixture(scope="module")
def facts(spark):
    """Key 1 holds about half the rows."""
    return spark.range(1, 401).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise((F.col("id") % 7).cast("int")).alias("k"),
        ((F.col("id") * 37) % 11).cast("double").alias("v"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_broadcast_join(spark, facts, how):
    dim = spark.createDataFrame([(0, "zero"), (1, "one"), (5, "five")], "k int, name string")
    plain = facts.join(dim, "k", how)
    small = joins.lookup_join(facts, dim, ["k"], how, salt_on="id")
    spark.conf.set(joins.BROADCAST_SETTING, "0")
    try:
        large = joins.lookup_join(facts, dim, ["k"], how, salt_on="id")
    finally:
        spark.conf.unset(joins.BROADCAST_SETTING)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert rows(small) == rows(large) == rows(plain)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_measured_bytes(spark):
    frame = spark.createDataFrame([(1, "abc", [1, 2]), (2, None, None)], "a int, b string, c array<int>")
    assert 30 < joins.measured_bytes(frame) < 120
    assert joins.measured_bytes(frame.limit(0)) == 0


def test_latest_by_key(spark):
    frame = spark.createDataFrame([("a", 1, "old"), ("a", 3, None), ("b", 2, "x")], "k string, seq int, v string")
    assert rows(joins.latest_by_key(frame, ["k"], "seq")) == [("a", 3, None), ("b", 2, "x")]


def test_upsert_keeps_changes_and_adds(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 20), (3, "c", 30)], "k int, v string, n int")
    keep_n = {"n": F.coalesce(F.col("o.n"), F.col("n.n"))}
    once = joins.upsert(old, new, ["k"], keep_n)
    assert rows(once) == [(1, "a", 1), (2, None, 2), (3, "c", 30)]
    assert rows(joins.upsert(once, new, ["k"], keep_n)) == rows(once)


@pytest.mark.parametrize("target", [10**6, 30])
def test_previous_row(facts, target):
    got = shards.with_previous(facts, "k", "id", ["v"], target).select("id", "prev.v").collect()
    last, want = {}, {}
    for row in sorted(facts.collect()):
        want[row["id"]] = last.get(row["k"])
        last[row["k"]] = row["v"]
    assert dict(map(tuple, got)) == want


@pytest.mark.parametrize("target", [10**6, 30])
def test_running_count(facts, target):
    got = shards.with_running_count(facts, "k", "id", F.col("v") > 5, "n", target).select("id", "n").collect()
    seen, want = {}, {}
    for row in sorted(facts.collect()):
        seen[row["k"]] = seen.get(row["k"], 0) + (row["v"] > 5)
        want[row["id"]] = seen[row["k"]]
    assert dict(map(tuple, got)) == want


def test_shards_are_bounded_even_when_a_key_comes_in_bursts(spark):
    frame = spark.range(1, 2001).select("id", F.lit(1).alias("k")).unionByName(
        spark.range(10**7, 10**7 + 5).select("id", F.lit(1).alias("k"))
    )
    hot = shards.hot_keys(frame, "k", "id", target=50)
    sizes = [r["count"] for r in shards.with_shard(frame, "k", "id", hot).groupBy("k", "shard").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == 2005


def test_dense_numbers_across_blocks(spark):
    frame = spark.range(0, 1000).select((F.col("id") * 977 % 100_003).alias("seq"))
    got = [r["n"] for r in shards.with_dense_number(frame, "seq", "n", block=1000).orderBy("seq").collect()]
    assert got == list(range(1, 1001))


def test_shards_follow_rows_however_far_apart_their_order_lies(spark):
    rows_, target = 900, 80
    frame = spark.range(rows_).select((F.col("id") * 100_000 + F.when(F.col("id") < 300, 0).otherwise(10**12)).alias("id"), F.lit(1).alias("k"))
    hot = shards.hot_keys(frame, "k", "id", target=target)
    sizes = [r["count"] for r in shards.with_shard(frame, "k", "id", hot).groupBy("k", "shard").count().collect()]
    assert sum(sizes) == rows_ and max(sizes) <= target and len(sizes) <= shards.SPREAD * rows_ / target + 1
