"""Health figures derived from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators.joins import lookup_join, tag_lookup
from tidemark.operators.registry import is_live


def plc_health(readings: DataFrame, tags: DataFrame, plcs: DataFrame) -> DataFrame:
    """Per controller: last sample, tags found by the last discovery, tags being logged.

    ``readings`` are the samples as they came in (tag_id, ts_received_utc). Stored readings will do for a
    store without a deadband; with one, a steady tag stores nothing although it is sampled, so pass the
    resolved notifications instead.
    """
    per_tag = readings.groupBy("tag_id").agg(F.max("ts_received_utc").alias("_last"))
    samples = lookup_join(per_tag, tag_lookup(tags, plcs), ["tag_id"]).groupBy("plc_id").agg(F.max("_last").alias("_last"))
    counts = tags.groupBy("plc_id").agg(
        F.sum((F.col("active") == 1).cast("long")).alias("_found"),
        F.sum(is_live().cast("long")).alias("_live"),
    )
    zero = F.lit(0).cast("long")
    return (
        plcs.select("plc_id", "name").join(samples, "plc_id", "left").join(counts, "plc_id", "left")
        .select(
            "plc_id", "name", times.iso_utc(F.col("_last")).alias("last_sample"),
            F.coalesce("_found", zero).alias("discovered_tags"), F.coalesce("_live", zero).alias("monitored_tags"),
        )
        .orderBy("name")
    )


def connection_state(events: DataFrame) -> DataFrame:
    """Per controller, after its last removal: connected or not, endpoint, last connect, last error.

    One aggregation that combines before the shuffle: the newest event of each kind per controller,
    each carrying its sequence number, compared with the number of the last removal.
    """
    seq, kind = F.col("seq"), F.col("kind")
    connected, disconnected = kind == "connected", kind == "disconnected"
    sets_error = connected | (disconnected & F.col("error").isNotNull())
    newest = events.groupBy("plc_name").agg(
        F.coalesce(F.max(F.when(kind == "removed", seq)), F.lit(-1)).alias("_removed"),
        F.max(F.when(connected | disconnected, F.struct("seq", connected.alias("on")))).alias("_state"),
        F.max(F.when(connected, F.struct("seq", "endpoint_url", "at"))).alias("_link"),
        F.max(F.when(sets_error, F.struct("seq", F.when(disconnected, F.col("error")).alias("error")))).alias("_error"),
    )
    linked = F.col("_link.seq") > F.col("_removed")
    return newest.filter(F.col("_state.seq") > F.col("_removed")).select(
        F.col("plc_name"), F.col("_state.on").alias("connected"),
        F.coalesce(F.when(linked, F.col("_link.endpoint_url")), F.lit("")).alias("endpoint_url"),
        F.when(linked, times.iso_utc(F.unix_millis("_link.at"))).alias("last_connected"),
        F.when(F.col("_error.seq") > F.col("_removed"), F.col("_error.error")).alias("last_error"),
    )


def health_snapshot(events: DataFrame, readings: DataFrame, tags: DataFrame, plcs: DataFrame) -> DataFrame:
    """Every controller that has connected or failed to since its last removal, with its figures."""
    figures = plc_health(readings, tags, plcs).drop("plc_id").withColumnRenamed("name", "plc_name")
    zero = F.lit(0).cast("long")
    return (
        connection_state(events).join(figures, "plc_name", "left")
        .withColumn("discovered_tags", F.coalesce("discovered_tags", zero))
        .withColumn("monitored_tags", F.coalesce("monitored_tags", zero)).orderBy("plc_name")
    )


def health_summary(readings: DataFrame, accepted: DataFrame, export_state: DataFrame, site: str) -> DataFrame:
    """One row: readings written, last write, rows still buffered, last export and upload.

    Each input is aggregated to one row first; the rows are then laid under each other.
    """
    layout = ["w", "t", "a", "e", "u"]
    zero, none_long, none_text = F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string")
    written = readings.agg(F.count("*"), F.max("ts_received_utc"), zero, none_text, none_text).toDF(*layout)
    taken = accepted.agg(zero, none_long, F.count("*"), none_text, none_text).toDF(*layout)
    exports = export_state.agg(zero, none_long, zero, F.max("exported_at"), F.max("uploaded_at")).toDF(*layout)
    totals = written.unionByName(taken).unionByName(exports).agg(
        F.sum("w").alias("readings_written"), F.max("t").alias("_t"), F.sum("a").alias("_a"),
        F.max("e").alias("last_export"), F.max("u").alias("last_upload"),
    )
    depth = F.greatest(F.lit(0).cast("long"), F.col("_a") - F.col("readings_written"))
    return totals.select(
        F.lit(site).alias("site"), "readings_written", times.iso_utc(F.col("_t")).alias("last_write"),
        depth.alias("buffer_depth"), "last_export", "last_upload",
    )
