"""Ordered work per key when one key may hold a third of all rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here a hot key is first cut into
*shards*: consecutive ranges of its order column that hold a bounded number of rows. Work runs per ``(key, shard)``; what must flow
from one shard to the next (a previous row, a running count) flows through a table with one row per
shard. Keys below the target keep a single shard, and if no key is above it nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import lookup_join
from tidemark.session import cut_lineage

TARGET_ROWS = 8_000_000  # no group of ordered work holds more rows than this
SPREAD = 4  # shards close at a quarter of it, to leave room for rows that come in bursts


def hot_keys(df: DataFrame, key: str, order: str, target: int = TARGET_ROWS) -> DataFrame | None:
    """Shards of the keys with more than ``target`` rows as cells of their order column, or None without any.

    ``order`` is a unique integer, so a cell of width w holds at most w rows. Cells are counted first and then
    joined into shards by the rows they hold, not by the range they cover: a shard closes once it has a fraction
    of ``target``. However far apart a key's rows lie, it gets at most SPREAD * rows / target + 1 shards, and
    none holds more than ``target`` rows even if they are bunched.
    """
    stats = df.groupBy(key).agg(
        F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")
    ).filter(F.col("_n") > target)
    cells = F.ceil(F.col("_n") * SPREAD * SPREAD / target)
    width = F.least(F.ceil((F.col("_hi") - F.col("_lo") + 1) / cells), F.lit(target // 2))
    wide = cut_lineage(stats.select(key, F.col("_lo"), F.greatest(width, F.lit(1)).cast("long").alias("_width")))
    if wide.isEmpty():
        return None
    placed = lookup_join(df.select(key, order), wide, [key], salt_on=order).withColumn("_cell", _cell(order))
    counted = placed.groupBy(key, "_lo", "_width", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    full = max(1, target // SPREAD)
    shard = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / full).cast("long").alias("shard")
    return cut_lineage(counted.select(key, "_lo", "_width", "_cell", shard))


def _cell(order: str) -> Column:
    return F.floor((F.col(order) - F.col("_lo")) / F.col("_width")).cast("long")


def with_shard(df: DataFrame, key: str, order: str, hot: DataFrame | None) -> DataFrame:
    """Add ``shard``: 0 for ordinary keys, the shard of the row's cell for hot ones."""
    if hot is None:
        return df.withColumn("shard", F.lit(0).cast("long"))
    wide = hot.select(key, "_lo", "_width").distinct()
    celled = lookup_join(df, wide, [key], "left", salt_on=order).withColumn("_cell", F.coalesce(_cell(order), F.lit(-1)))
    joined = lookup_join(celled.drop("_lo", "_width"), hot.select(key, "_cell", "shard"), [key, "_cell"], "left", salt_on=order)
    return joined.withColumn("shard", F.coalesce("shard", F.lit(0))).drop("_cell")


def with_previous(
    df: DataFrame, key: str, order: str, columns: list[str], target: int = TARGET_ROWS
) -> DataFrame:
    """Add ``prev``, a struct of ``columns`` from the key's preceding row; null on its first row."""
    hot = hot_keys(df, key, order, target)
    sharded = with_shard(df, key, order, hot)
    inside = Window.partitionBy(key, "shard").orderBy(order)
    row = F.struct(*columns)
    with_local = sharded.withColumn("prev", F.lag(row).over(inside))
    if hot is None:
        return with_local.drop("shard")
    ends = (
        with_shard(lookup_join(df, hot.select(key).distinct(), [key], "left_semi", salt_on=order), key, order, hot)
        .groupBy(key, "shard").agg(F.max_by(row, order).alias("_end"))
    )
    carried = ends.select(
        key, "shard", F.lag("_end").over(Window.partitionBy(key).orderBy("shard")).alias("_carried")
    )
    # (key, shard) groups are bounded, so this join needs no salt.
    return (
        lookup_join(with_local, carried, [key, "shard"], "left")
        .withColumn("prev", F.coalesce("prev", "_carried")).drop("_carried", "shard")
    )


def with_running_count(
    df: DataFrame, key: str, order: str, flag: Column, name: str, target: int = TARGET_ROWS
) -> DataFrame:
    """Add ``name``: how many of the key's rows up to and including this one have ``flag`` set."""
    flagged = df.withColumn("_flag", flag.cast("long"))
    hot = hot_keys(flagged, key, order, target)
    sharded = with_shard(flagged, key, order, hot)
    inside = Window.partitionBy(key, "shard").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = sharded.withColumn(name, F.sum("_flag").over(inside))
    if hot is None:
        return counted.drop("_flag", "shard")
    sums = (
        with_shard(lookup_join(flagged, hot.select(key).distinct(), [key], "left_semi", salt_on=order), key, order, hot)
        .groupBy(key, "shard").agg(F.sum("_flag").alias("_sum"))
    )
    before = Window.partitionBy(key).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "shard", F.sum("_sum").over(before).alias("_offset"))
    return (
        lookup_join(counted, offsets, [key, "shard"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_flag", "_offset", "shard")
    )


def with_dense_number(df: DataFrame, order: str, name: str, block: int = 1 << 20) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... along the unique integer ``order``, without one global window.

    Rows are numbered inside blocks of ``block`` consecutive order values; a table with one row per
    block carries how many rows came before it.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(order)
    return (
        lookup_join(blocked.withColumn("_inside", F.row_number().over(inside)), offsets, ["_block"])
        .withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")
    )
