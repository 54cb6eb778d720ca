"""Walking the address space of every controller of the fleet at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators.joins import BROADCAST_BYTES, BROADCAST_SETTING, lookup_join, measured_bytes
from tidemark.operators.registry import passes_tag_filter
from tidemark.session import cut_lineage, shared_dir

# Well-known node ids and the depth limit of a walk.
OBJECTS_FOLDER = "i=85"
SERVER = "i=2253"
MAX_DEPTH = 30

LEVELS_PER_JOB = 8


def browsable(edges: DataFrame) -> DataFrame:
    """References to objects and variables; methods and the rest are never followed."""
    return edges.filter(F.col("node_class").isin("Object", "Variable"))


def reachable(edges: DataFrame, root: str = OBJECTS_FOLDER, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(plc_name, node, depth): nodes with children that are read, each at its shortest depth.

    Breadth first over all controllers together, a few levels per job. Within a job a level is one join of the
    level before with the references to nodes that have children; what was reached is reduced to the
    smallest depth and anti-joined with the nodes already seen, which removes cycles and second parents. A level never holds
    more than the nodes that have children: where those fit the bound for a broadcast, the references stay where they are and
    only what they lead to is shuffled.
    Jobs write folders of one table in the shared folder, so the plan stays the same size and a lost
    executor costs one job at most. The Server object is never expanded.
    """
    return _walk(cut_lineage(_followed(edges)), root, max_depth)


def _followed(edges: DataFrame) -> DataFrame:
    return browsable(edges).filter(F.col("child") != SERVER).select("plc_name", "parent", "child")


def _walk(links: DataFrame, root: str, max_depth: int) -> DataFrame:
    spark = links.sparkSession
    parents = cut_lineage(links.select("plc_name", F.col("parent").alias("child")).distinct())
    inner = cut_lineage(lookup_join(links, parents, ["plc_name", "child"], "left_semi", salt_on="parent"))
    bound = int(spark.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))
    near = F.broadcast if measured_bytes(parents) <= bound else lambda df: df  # a level, and all that was seen, are among the parents
    table = shared_dir(spark, "levels")
    layout = "plc_name string, node string, depth int"
    found = links.filter(F.col("parent") == root).select("plc_name", F.lit(root).alias("node"), F.lit(0).alias("depth")).distinct()
    depth = 0
    while True:
        found.write.parquet(f"{table}/to={depth}")
        level = spark.read.schema(layout).parquet(f"{table}/to={depth}").filter(F.col("depth") == depth).drop("depth")
        seen = spark.read.schema(layout).parquet(table).select("plc_name", "node", "depth")
        if depth >= max_depth or level.isEmpty():
            return seen
        levels = []
        for n in range(depth + 1, min(depth + LEVELS_PER_JOB, max_depth) + 1):
            level = level.withColumnRenamed("node", "parent")
            step = inner.join(near(level), ["plc_name", "parent"], "left_semi")
            level = step.select("plc_name", F.col("child").alias("node")).distinct()
            levels.append(level.withColumn("depth", F.lit(n)))
        reached = reduce(DataFrame.unionByName, levels).groupBy("plc_name", "node").agg(F.min("depth").alias("depth"))
        found = reached.join(near(seen.select("plc_name", "node")), ["plc_name", "node"], "left_anti")
        depth += len(levels)


def discover_tags(
    edges: DataFrame, namespaces: list[int] | None = None, tokens: list[str] | None = None,
    exclude_namespace_zero: bool = True, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Every variable below the objects folder that passes the tag filter, once per controller.

    A variable counts as soon as its parent is read, so it may lie one level below the last node
    that is expanded. If it is reached under several names the first in code-point order is taken: edges carry
    no order in which they were met. The references are written down once, as the walk and the variables both read them.
    """
    edges = cut_lineage(browsable(edges).select("plc_name", "parent", "child", "node_class", "display_name", "browse_name"))
    expanded = _walk(_followed(edges), OBJECTS_FOLDER, max_depth).select("plc_name", F.col("node").alias("parent"))
    variables = edges.filter(
        (F.col("node_class") == "Variable")
        & passes_tag_filter(F.col("child"), namespaces, tokens, exclude_namespace_zero)
    )
    met = lookup_join(variables, expanded, ["plc_name", "parent"], "left_semi", salt_on="child")
    leaf = names.leaf_name(F.col("display_name"), F.col("browse_name"), F.col("child"))
    return (
        met.select("plc_name", F.col("child").alias("node_id"), names.tag_name(F.col("child"), leaf).alias("tag_name"))
        .groupBy("plc_name", "node_id").agg(F.min("tag_name").alias("tag_name"))
    )
