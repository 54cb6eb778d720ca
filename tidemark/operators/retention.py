"""What may be pruned, and what remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import HOUR_MS, retention_cutoff, window_start
from tidemark.operators.aggregates import prune_watermark
from tidemark.operators.joins import lookup_join


def is_prunable(cutoff_ms: int, watermark: int | None = None) -> Column:
    """Older than the cutoff and, with a watermark, known to be off the machine."""
    old = F.col("ts_utc") < cutoff_ms
    return old if watermark is None else old & (F.col("id") <= watermark)


def retained(readings: DataFrame, cutoff_ms: int, watermark: int | None = None) -> DataFrame:
    return readings.filter(~is_prunable(cutoff_ms, watermark))


def without_pruned(readings: DataFrame, pruned_ids: DataFrame) -> DataFrame:
    """The complement when the pruned ids are a table of their own.

    The ids travel as words of 64 neighbouring ids, one bit each: what is pruned are mostly runs of ids, so the words take a
    fraction of the ids' room and are broadcast within the usual bound, which leaves the history where it is. Beyond the bound
    both sides are shuffled by word and salt. A reading without an id is never pruned.
    """
    block, bit = F.shiftright("id", 6), (F.col("id").bitwiseAND(F.lit(63))).cast("int")
    words = pruned_ids.select("id").filter("id IS NOT NULL").groupBy(block.alias("_block")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("_word")
    )
    joined = lookup_join(readings.withColumn("_block", block), words, ["_block"], "left", salt_on="id")
    listed = F.col("_word").isNotNull() & (F.getbit(F.col("_word"), bit) == 1)
    return joined.filter(~F.coalesce(listed, F.lit(False))).select(*readings.columns)


def retained_safely(readings: DataFrame, cutoff_ms: int, partitions: DataFrame) -> DataFrame:
    """Prune a reading only if the export of its own window is uploaded and reached its id.

    The plain watermark is one id for the whole store, so a reading that arrived after its window
    was exported can fall below it without ever having been copied.
    """
    uploaded = partitions.filter(F.col("uploaded_at").isNotNull()).select(
        "partition_start", "partition_hours", "max_reading_id"
    )
    # Window sizes are whole hours; the few in use are found first and joined one at a time.
    in_use = sorted(row[0] for row in uploaded.select("partition_hours").distinct().collect())
    joined, safe = readings, F.lit(False)
    for hours in in_use:
        windows = uploaded.filter(F.col("partition_hours") == hours).select(
            F.col("partition_start").alias("_window"), F.col("max_reading_id").alias(f"_reach{hours}")
        )
        joined = joined.withColumn("_window", window_start(F.col("ts_utc"), hours * HOUR_MS))
        joined = lookup_join(joined, windows, ["_window"], "left", salt_on="id")
        safe = safe | (F.col("id") <= F.coalesce(f"_reach{hours}", F.lit(-1)))
    return joined.filter(~((F.col("ts_utc") < cutoff_ms) & safe)).select(*readings.columns)


def sweep_decision(
    partitions: DataFrame, settings: DataFrame, as_of_ms: int, days: int, upload_enabled: bool
) -> tuple[int, int | None] | None:
    """Cutoff and watermark of a retention sweep, or None when nothing may be pruned."""
    if days <= 0:
        return None
    cutoff = retention_cutoff(as_of_ms, days)
    if not upload_enabled:
        return cutoff, None
    watermark = prune_watermark(partitions, settings).first()[0]
    return None if watermark == 0 else (cutoff, watermark)


def sweep(
    readings: DataFrame, partitions: DataFrame, settings: DataFrame, as_of_ms: int, days: int, upload_enabled: bool
) -> DataFrame:
    """The readings a retention sweep leaves."""
    decision = sweep_decision(partitions, settings, as_of_ms, days, upload_enabled)
    return readings if decision is None else retained(readings, *decision)


def late_readings(readings: DataFrame, cursor_ms: int, exported_id: int) -> DataFrame:
    """Readings that arrived after an export whose cursor had already passed their time."""
    return readings.filter((F.col("id") > exported_id) & (F.col("ts_utc") < cursor_ms))


def windows_to_reexport(late: DataFrame, size_ms: int) -> DataFrame:
    """The windows that have to be exported again to include late readings."""
    start = window_start(F.col("ts_utc"), size_ms)
    return late.groupBy(start.alias("partition_start")).agg(F.count("*").alias("late_rows"))
