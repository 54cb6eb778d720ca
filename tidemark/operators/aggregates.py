"""Bounds, per-file statistics and run totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators.joins import lookup_join, tag_lookup

# The settings keys.
EXPORT_CURSOR_KEY = "parquet_export_cursor"
BACKUP_WATERMARK_KEY = "backup_uploaded_reading_id"


def reading_bounds(readings: DataFrame) -> DataFrame:
    """Highest id (0 when empty) and lowest source time (-1 when empty)."""
    return readings.agg(
        F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("max_id"),
        F.coalesce(F.min("ts_utc"), F.lit(-1)).cast("long").alias("min_ts"),
    )


def csv_spans(readings: DataFrame, tags: DataFrame, plcs: DataFrame) -> DataFrame:
    """Per controller: rows, lowest and highest id, first and last time in id order.

    Readings are reduced to one row per tag before they meet the tags, so the history is not shuffled.
    """
    per_tag = readings.groupBy("tag_id").agg(
        F.count("*").alias("_n"), F.min("id").alias("_low"), F.max("id").alias("_high"),
        F.min_by("ts_utc", "id").alias("_first"), F.max_by("ts_utc", "id").alias("_last"),
    )
    return lookup_join(per_tag, tag_lookup(tags, plcs), ["tag_id"]).groupBy("plc_id", "plc_name").agg(
        F.sum("_n").alias("row_count"), F.min("_low").alias("min_reading_id"), F.max("_high").alias("max_reading_id"),
        times.iso_utc(F.min_by("_first", "_low")).alias("period_start"),
        times.iso_utc(F.max_by("_last", "_high")).alias("period_end"),
    )


def csv_stats(readings: DataFrame, tags: DataFrame, plcs: DataFrame) -> DataFrame:
    """As ``csv_spans``, without the lowest id."""
    return csv_spans(readings, tags, plcs).drop("min_reading_id")


def window_spans(readings: DataFrame, tags: DataFrame, plcs: DataFrame, size_ms: int) -> DataFrame:
    """Per time window: rows, lowest and highest id of what an export of that window holds.

    Readings are reduced to one row per tag and window before they meet the tags.
    """
    window = times.window_start(F.col("ts_utc"), size_ms).alias("partition_start")
    per_tag = readings.groupBy("tag_id", window).agg(F.count("*").alias("_n"), F.min("id").alias("_low"), F.max("id").alias("_high"))
    known = lookup_join(per_tag, tag_lookup(tags, plcs).select("tag_id"), ["tag_id"], salt_on="partition_start")
    return known.groupBy("partition_start").agg(
        F.sum("_n").alias("row_count"), F.min("_low").alias("min_reading_id"), F.max("_high").alias("max_reading_id")
    )


def window_stats(readings: DataFrame, tags: DataFrame, plcs: DataFrame, size_ms: int) -> DataFrame:
    """As ``window_spans``, without the lowest id."""
    return window_spans(readings, tags, plcs, size_ms).drop("min_reading_id")


def run_totals(stats: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for a run: rows and files written, files uploaded and failed."""
    zero = F.lit(0).cast("long")
    written = stats.select(
        F.col("row_count").cast("long").alias("r"), F.lit(1).alias("f"), zero.alias("u"), zero.alias("x")
    )
    sent = outcomes.select(
        zero.alias("r"), F.lit(0).alias("f"),
        (F.col("outcome") == "ok").cast("long").alias("u"), (F.col("outcome") == "failed").cast("long").alias("x"),
    )
    total = {"r": "exported_rows", "f": "files", "u": "uploaded", "x": "failed"}
    return written.unionByName(sent).agg(
        *[F.coalesce(F.sum(column), zero).cast("long").alias(name) for column, name in total.items()]
    )


def last_export_upload(export_state: DataFrame, partitions: DataFrame) -> DataFrame:
    """Last export and upload time of the CSV files, and the same for the Parquet windows."""
    none = F.lit(None).cast("string")
    csv = export_state.select(
        F.col("exported_at").alias("a"), F.col("uploaded_at").alias("b"), none.alias("c"), none.alias("d")
    )
    windows = partitions.select(
        none.alias("a"), none.alias("b"), F.col("exported_at").alias("c"), F.col("uploaded_at").alias("d")
    )
    return csv.unionByName(windows).agg(
        F.max("a").alias("last_export"), F.max("b").alias("last_upload"),
        F.max("c").alias("last_window_export"), F.max("d").alias("last_window_upload"),
    )


def setting_long(settings: DataFrame, key: str) -> DataFrame:
    """A numeric setting as a one-row table, 0 when it is not set."""
    found = settings.filter(F.col("key") == key)
    return found.agg(F.coalesce(F.max(F.expr("try_cast(value AS BIGINT)")), F.lit(0)).cast("long").alias("value"))


def prune_watermark(partitions: DataFrame, settings: DataFrame) -> DataFrame:
    """Highest reading id known to be off the machine: by backup or by an uploaded window."""
    uploaded = partitions.filter(F.col("uploaded_at").isNotNull()).agg(
        F.coalesce(F.max("max_reading_id"), F.lit(0)).cast("long").alias("value")
    )
    return (
        setting_long(settings, BACKUP_WATERMARK_KEY).unionByName(uploaded)
        .agg(F.coalesce(F.max("value"), F.lit(0)).alias("watermark"))
    )


def write_totals(readings: DataFrame) -> DataFrame:
    return readings.agg(
        F.count("*").alias("readings_written"), F.max("ts_received_utc").alias("last_write_ms")
    )


def backlog(accepted: DataFrame, written: DataFrame) -> DataFrame:
    """Accepted but not yet written, never below zero."""
    marks = accepted.select(F.lit(1).alias("a"), F.lit(0).alias("w")).union(
        written.select(F.lit(0).alias("a"), F.lit(1).alias("w"))
    )
    zero = F.lit(0).cast("long")
    return marks.agg(
        F.coalesce(F.sum("a"), zero).alias("accepted"), F.coalesce(F.sum("w"), zero).alias("written")
    ).withColumn("backlog", F.greatest(zero, F.col("accepted") - F.col("written")))
