"""Merging sorted digest runs up a tree and handing the outcome back down to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

FAN_IN = 8
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def tree_rounds(df: DataFrame, fan_in: int = FAN_IN) -> int:
    """Rounds after which a run exists for every shuffle partition of the session."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while fan_in**rounds < partitions:
        rounds += 1
    return rounds


def tree_merge(members: DataFrame, key: list[str], order: str, fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """Adds ``first`` (the smallest ``order`` among the rows with the same ``key``) and ``group_size``.

    Rows are dealt to ``fan_in ** rounds`` runs by the hash of ``order``. A run is a table sorted by key
    with one row per key. In every round ``fan_in`` neighbouring runs are merged: equal keys keep the
    smaller ``order`` and add up their rows. The root then goes down the same tree, so neither way does a
    task see more than ``fan_in`` entries of a key from each run, however many rows share the key.
    ``members`` must be a written table (it is read twice), its key columns not null.
    """
    rounds = tree_rounds(members, fan_in) if rounds is None else rounds
    members = members.withColumn("_run", F.pmod(F.xxhash64(order), F.lit(fan_in**rounds)))
    entry = [F.min("first").alias("first"), F.sum("group_size").alias("group_size")]
    level = members.groupBy(*key, "_run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    levels = [cut_lineage(level.sortWithinPartitions(*key))]
    for _ in range(rounds):
        merged = levels[-1].withColumn("_run", F.floor(F.col("_run") / fan_in)).groupBy(*key, "_run").agg(*entry)
        levels.append(cut_lineage(merged.sortWithinPartitions(*key)))
    found = levels[-1]
    for lower in reversed(levels[:-1]):
        above = found.withColumnRenamed("_run", "_above")
        below = lower.select(*key, "_run", F.floor(F.col("_run") / fan_in).alias("_above"))
        found = below.join(above, [*key, "_above"]).drop("_above")
    return members.join(found, [*key, "_run"]).drop("_run")


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (``id``, ``text_sha256``), with all their columns.

    A row is named by its id and the digest of its normalised text together, so that a digest shared by
    many rows stays spread. Repeated rows of one name come out once.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name(F.col(id_col)).alias("_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("_sha"),
    )
    names = kept.select(name(F.col("id")).alias("_id"), F.col("text_sha256").alias("_sha"))
    return rows.join(names, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select("row.*")
