"""Jobs over the whole fleet: ingest as a batch, discovery, configuration report, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times, values
from tidemark.operators import deadband, discovery, registry
from tidemark.operators.joins import lookup_join
from tidemark.session import cut_lineage


def normalise(raw: DataFrame) -> DataFrame:
    """Raw notifications as readings: value or text, quality code, times in epoch milliseconds."""
    number, flag, text = F.col("v_num"), F.col("v_bool"), F.col("v_text")
    keep = [c for c in ("tag_id", "plc_name", "node_id") if c in raw.columns]
    return raw.select(
        F.col("seq").alias("id"), *keep,
        times.epoch_ms(times.event_time(F.col("source_ts"), F.col("received_ts"))).alias("ts_utc"),
        times.epoch_ms(F.col("received_ts")).alias("ts_received_utc"),
        values.numeric_value(number, flag).alias("value"),
        values.text_value(number, flag, text).alias("value_text"),
        values.quality_code(values.status_quality(F.col("status_code"))).alias("quality"),
        values.type_name(number, flag, text, F.col("data_type")).alias("data_type"),
    )


def ingest(
    raw: DataFrame, tags: DataFrame, plcs: DataFrame, default_deadband: float = 0.0, exempt_boolean: bool = False
) -> DataFrame:
    """Notifications to stored readings as one batch; the stream gives the same rows."""
    resolved = normalise(registry.resolve_notifications(raw, tags, plcs)).drop("plc_name", "node_id")
    exempt = (F.col("data_type") == "Boolean") if exempt_boolean else None
    return deadband.deadband(resolved, tags, default_deadband, exempt)


def discovery_sync(
    edges: DataFrame, tags: DataFrame, plcs: DataFrame, as_of: str,
    namespaces: list[int] | None = None, tokens: list[str] | None = None,
) -> DataFrame:
    """Walk the address spaces and bring the tag registry in step: the new tag table.

    Every controller with any reference counts as scanned. New tags are numbered in (controller,
    node id) order: the range-sorted rows get increasing numbers, which are written down before
    anything else uses them, since computing them again could give others.
    """
    found = discovery.discover_tags(edges, namespaces, tokens)
    ids = plcs.select("plc_id", F.col("name").alias("plc_name"))
    ordered = lookup_join(found, ids, ["plc_name"], salt_on="node_id").orderBy("plc_id", "node_id")
    numbered = cut_lineage(
        ordered.select("plc_id", "node_id", "tag_name", F.monotonically_increasing_id().alias("seq"))
    )
    scanned = cut_lineage(lookup_join(edges.select("plc_name").distinct(), ids, ["plc_name"]).select("plc_id"))
    return registry.sync_tags(tags, numbered, scanned, as_of)


def config_report(documents: DataFrame) -> DataFrame:
    """Issues per site and severity."""
    return (
        registry.config_issues(documents).groupBy("site", "severity").agg(F.count("*").alias("issues"))
    )
