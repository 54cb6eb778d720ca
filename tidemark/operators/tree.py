"""The folder tree implied by dotted tag names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names


def path_parts(tags: DataFrame) -> DataFrame:
    segments = names.path_segments(F.col("tag_name"))
    return tags.select(
        "tag_id", "tag_name", names.folder_path(F.col("tag_name")).alias("folder"),
        F.element_at(segments, -1).alias("leaf"), F.size(segments).alias("depth"),
    )


def folder_rollup(tags: DataFrame) -> DataFrame:
    """Per folder: active tags below it, how many are selected, and all / partial / none.

    Each tag counts once per folder above it, the root (empty path) included; counts are combined
    before the shuffle, so the root of a huge controller is no heavier than any other folder.
    """
    active = tags.filter(F.col("active") == 1)
    spread = active.select(
        "plc_id", F.explode(names.folder_prefixes(F.col("tag_name"))).alias("folder"),
        (F.col("enabled") == 1).cast("int").alias("_on"),
    )
    counted = spread.groupBy("plc_id", "folder").agg(
        F.count("*").alias("leaves"), F.sum("_on").cast("long").alias("selected")
    )
    state = (
        F.when(F.col("selected") == F.col("leaves"), F.lit("all"))
        .when(F.col("selected") > 0, F.lit("partial")).otherwise(F.lit("none"))
    )
    return counted.withColumn("state", state)


def sibling_order(tags: DataFrame) -> DataFrame:
    """The children of every folder: folders first, then tags, each by code-point order."""
    active = tags.filter(F.col("active") == 1)
    leaves = active.select(
        "plc_id", names.folder_path(F.col("tag_name")).alias("parent"),
        F.element_at(names.path_segments(F.col("tag_name")), -1).alias("name"),
        F.lit(1).alias("is_leaf"), "tag_id",
    )
    folders = (
        active.select("plc_id", F.explode(names.folder_prefixes(F.col("tag_name"))).alias("_path"))
        .filter(F.col("_path") != "").distinct()
        .select(
            "plc_id", names.folder_path(F.col("_path")).alias("parent"),
            F.element_at(names.path_segments(F.col("_path")), -1).alias("name"),
            F.lit(0).alias("is_leaf"), F.lit(None).cast("int").alias("tag_id"),
        )
    )
    return folders.unionByName(leaves).orderBy("plc_id", "parent", "is_leaf", "name", "tag_id")
