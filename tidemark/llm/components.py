"""Connected groups of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, release


def _pointed(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's larger (or smaller) neighbours, and itself, pointed at its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.filter("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = (both.filter("b > a") if larger else near).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return (moved if larger else moved.unionByName(own)).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its group) for every node of ``links`` (a, b).

    Large-star and small-star steps in turn: each step points neighbours at the smallest node they know of,
    until every group is a star around its smallest node. The number of steps grows with the logarithm of a
    group's width; every step is a shuffle join on node pairs.
    """
    edges = cut_lineage(links.filter("a <> b").distinct())
    before = None
    while True:
        pointed = cut_lineage(_pointed(_pointed(edges, True), False))
        release(edges)
        edges = pointed
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links`` (a, b) between nodes, labelled already or not: only groups are connected anew."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"group_{side}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    named = cut_lineage(named.select("a", "b", F.coalesce("group_a", "a").alias("x"), F.coalesce("group_b", "b").alias("y")))
    groups = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    fresh = named.select(F.col("a").alias("node"), F.col("x").alias("label")).unionByName(named.select(F.col("b").alias("node"), F.col("y").alias("label")))
    every = labels.unionByName(fresh).distinct()
    moved = every.join(groups.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left")
    made = cut_lineage(moved.select("node", F.coalesce("_to", "label").alias("label")))
    release(named)
    return made
