"""The export jobs: closed Parquet windows, rolling CSV, CSV of a time window, full snapshot.

A job scans the readings twice: three columns of them for the rows and ids per file, which give the manifest and the
bounds of the writing tasks, then everything for the files. Both scans see the same files of the dataset.

Uploading is done by whatever moves files. Its result is a table (file_name, outcome, at) that drives
the manifests; a job takes that table, or a function that is given the pending files and returns it. A function that
yields one (file_name, outcome, at) after the other has each recorded before it goes on to the next file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import names, times
from tidemark.operators import aggregates, joins, manifests, scans
from tidemark.session import cut_lineage
from tidemark.sinks import exports

Outcomes = DataFrame | Callable[[DataFrame], DataFrame | Iterator[tuple]]


def _outcomes_of(outcomes: Outcomes, pending: DataFrame, sent: Callable[[DataFrame], None] | None) -> DataFrame:
    """All outcomes as a table; those that come one by one are handed to ``sent`` as they come."""
    given = outcomes if isinstance(outcomes, DataFrame) else outcomes(pending)
    if isinstance(given, DataFrame):
        return given
    spark, rows = pending.sparkSession, []
    for row in given:  # a row per uploaded file
        rows.append(tuple(row))
        if sent is not None:
            sent(spark.createDataFrame(rows[-1:], schemas.UPLOAD_OUTCOMES))
    return spark.createDataFrame(rows, schemas.UPLOAD_OUTCOMES)


@dataclass
class CycleResult:
    manifest: DataFrame
    settings: DataFrame
    exported: DataFrame
    cursor: int


def elapsed_range(readings: DataFrame, settings: DataFrame, as_of_ms: int, size_ms: int) -> tuple[int, int] | None:
    """Start of the first and end of the last window to export, or None when there is nothing yet.

    Starts at the cursor or the oldest reading, whichever is later, aligned down; ends before the
    window that is still open. The oldest reading matters only while nothing is older than the
    cursor, so a store that has been exported before is not scanned for it.
    """
    cursor = aggregates.setting_long(settings, aggregates.EXPORT_CURSOR_KEY).first()[0]
    before = scans.in_range(readings, 0, cursor, closed=False)
    if cursor > 0 and not before.select("ts_utc").isEmpty():
        start = cursor
    else:
        oldest = aggregates.reading_bounds(readings.select("id", "ts_utc")).first()["min_ts"]
        if oldest < 0:
            return None
        start = max(oldest, cursor)
    first = start // size_ms * size_ms
    last = times.last_elapsed_window(as_of_ms, size_ms)
    return (first, last + size_ms) if first <= last else None


def partition_cycle(
    readings: DataFrame, tags: DataFrame, plcs: DataFrame, manifest: DataFrame, settings: DataFrame,
    outcomes: Outcomes, path: str, site: str, as_of_ms: int, hours: int = 6, keep: bool = False,
    retention_days: int = 90, recorded: Callable[[DataFrame, int], None] | None = None,
    sent: Callable[[DataFrame], None] | None = None,
) -> CycleResult:
    """Export every closed window in one pass, then record what the uploads achieved.

    The manifest changes only after the files are written, and the cursor with it, so a failed run
    is simply run again. Empty windows write nothing but the cursor passes them. ``recorded`` is handed
    the manifest and the cursor before anything is uploaded, so that an upload that fails loses neither.
    Pending windows go to the uploader with the ``folder`` that holds their files. ``sent`` is handed each outcome of an
    uploader that yields them.
    """
    size_ms, as_of = max(1, hours) * times.HOUR_MS, times.ms_to_iso(as_of_ms)
    span = elapsed_range(readings, settings, as_of_ms, size_ms)
    stats = None
    if span is not None:
        fresh = scans.in_range(readings, *span, closed=False)
        spans = cut_lineage(aggregates.window_spans(fresh, tags, plcs, size_ms))
        exports.write_windows(scans.range_readings(readings, tags, plcs, *span), path, size_ms, spans)
        stats = spans.drop("min_reading_id")
        records = manifests.partition_records(stats, site, max(1, hours))
        manifest = cut_lineage(manifests.record_partitions(manifest, records, as_of))
        settings = manifests.put_setting(settings, aggregates.EXPORT_CURSOR_KEY, span[1])
        if recorded is not None:
            recorded(manifest, span[1])
    folder = F.concat(F.lit(f"{path}/partition_start="), F.col("partition_start").cast("string"))
    results = _outcomes_of(outcomes, manifests.pending_partitions(manifest).withColumn("folder", folder), sent)
    manifest = manifests.apply_partition_outcomes(manifest, results, as_of, keep)
    if keep:
        cutoff = times.retention_cutoff(as_of_ms, retention_days) if retention_days > 0 else None
        manifest = manifests.cleanup_kept(manifest, cutoff)
    if stats is None:
        stats = manifest.limit(0).select("partition_start", "row_count", "max_reading_id")
    return CycleResult(manifest, settings, stats, span[1] if span else -1)


def rolling_csv(
    readings: DataFrame, tags: DataFrame, plcs: DataFrame, state: DataFrame, outcomes: Outcomes,
    path: str, site: str, as_of: str, saved: Callable[[DataFrame], None] | None = None,
    sent: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Rewrite every controller's CSV, record it, and apply the upload outcomes: the new state.

    ``saved`` is handed the recorded state before anything is uploaded.
    """
    logged = joins.plcs_with_tags(plcs, tags)
    spans = cut_lineage(aggregates.csv_spans(readings, tags, logged))
    exports.write_rolling_csv(scans.export_rows(readings, tags, logged), path, spans)
    recorded = cut_lineage(manifests.record_exports(state, manifests.export_records(spans, site, path), as_of))
    if saved is not None:
        saved(recorded)
    results = _outcomes_of(outcomes, manifests.pending_uploads(recorded), sent)
    return manifests.apply_export_outcomes(recorded, results, as_of)


def window_csv(
    readings: DataFrame, tags: DataFrame, plcs: DataFrame, path: str, site: str, start_ms: int, end_ms: int
) -> DataFrame:
    """Write the CSV of a closed time window; one row per file written.

    The files are snapshots of their own and touch no manifest. An end at or before the start is
    refused.
    """
    if end_ms <= start_ms:
        raise ValueError(f"the window must end after {start_ms}, not at {end_ms}")
    logged = joins.plcs_with_tags(plcs, tags)
    spans = cut_lineage(aggregates.csv_spans(scans.in_range(readings, start_ms, end_ms, closed=True), tags, logged))
    exports.write_window_csv(scans.export_rows_in_range(readings, tags, logged, start_ms, end_ms), path, spans)
    file_name = names.window_csv_file(F.lit(site), F.col("plc_name"), F.lit(start_ms), F.lit(end_ms))
    return spans.drop("min_reading_id").withColumn("file_name", file_name)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Copy every state table and the readings; one row per table with its rows and highest id.

    Each table is read once at the version its DataFrame is pinned to. The counts come from the
    copy, so they describe exactly what was written.
    """
    spark = next(iter(tables.values())).sparkSession
    summary = None
    for name, table in tables.items():
        exports.write_table(table, f"{path}/{name}")
        copy = spark.read.schema(table.schema).parquet(f"{path}/{name}")
        highest = F.max("id") if name == "readings" else F.lit(None)
        line = copy.agg(F.count("*").alias("row_count"), highest.cast("long").alias("max_id"))
        line = line.select(F.lit(name).alias("table_name"), "row_count", "max_id")
        summary = line if summary is None else summary.unionByName(line)
    return summary


def snapshot_highest(tables: dict[str, DataFrame], path: str) -> tuple[DataFrame, int]:
    """Snapshot the store: the summary of the copy, and the highest id it surely holds.

    The highest id is read before the copy starts, so rows that arrive meanwhile stay above it.
    """
    highest = aggregates.reading_bounds(tables["readings"].select("id", "ts_utc")).first()["max_id"]
    return snapshot(tables, path), highest


def snapshot_watermark(
    tables: dict[str, DataFrame], path: str, delivered: bool
) -> tuple[DataFrame, DataFrame]:
    """Snapshot the store and, once it is delivered, move the backup watermark: the summary and the new settings."""
    summary, highest = snapshot_highest(tables, path)
    settings = tables["settings"]
    if delivered:
        settings = manifests.put_setting(settings, aggregates.BACKUP_WATERMARK_KEY, highest)
    return summary, settings
