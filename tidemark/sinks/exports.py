"""Writers for readings, window exports, CSV exports and snapshots.

Rows are dealt to tasks by file key and id before a write. A controller or window that holds a
third of all rows is therefore cut into several files of consecutive ids instead of passing through
one task, and the files of a folder, in name order, are in id order. Where the jobs have counted the rows per key anyway,
the bounds come from those counts; else Spark samples them, at the price of one more run of all that the rows come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import scans
from tidemark.operators.joins import lookup_join

ROWS_PER_FILE = 5_000_000


def write_readings(readings: DataFrame, path: str, mode: str = "append") -> None:
    """Store readings by UTC date, each file sorted so that Parquet statistics prune by tag and time."""
    (
        readings.withColumn("dt", times.utc_date(F.col("ts_utc")))
        .repartitionByRange("dt", "tag_id", "ts_utc").sortWithinPartitions("dt", "tag_id", "ts_utc")
        .write.partitionBy("dt").option("maxRecordsPerFile", ROWS_PER_FILE).mode(mode).parquet(path)
    )


def slices(spans: list[tuple], target: int) -> tuple[list[tuple], int]:
    """(key, task, low, width, parts) for (key, rows, lowest id, highest id) in order of the keys, and the number of tasks.

    Small keys share a task, large ones get a task per ``target`` rows or so: task + (id - low) / width.
    """
    dealt, task, filled = [], 0, 0
    for key, count, low, high in spans:
        parts = max(1, -(-count // target))
        if filled and (parts > 1 or filled + count > target):
            task, filled = task + 1, 0
        dealt.append((key, task, low, (high - low) // parts + 1, parts))
        if parts > 1:
            task += parts
        else:
            filled += count
    return dealt, task + (filled > 0)


def _arranged(rows: DataFrame, key: str, spans: DataFrame | None) -> DataFrame:
    """Rows by key and id in the tasks that write them. ``spans``: the key, row_count, min_reading_id, max_reading_id."""
    if spans is None:
        return rows.repartitionByRange(key, "id").sortWithinPartitions(key, "id")
    found = spans.select(key, "row_count", "min_reading_id", "max_reading_id").orderBy(key).collect()  # a row per file key, as in the manifest
    cores = rows.sparkSession.sparkContext.defaultParallelism
    target = max(1, min(ROWS_PER_FILE, -(-sum(r["row_count"] for r in found) // (2 * cores))))
    dealt, tasks = slices([tuple(r) for r in found], target)
    kind = spans.schema[key].dataType.simpleString()
    bounds = rows.sparkSession.createDataFrame(dealt, f"{key} {kind}, _task int, _low long, _width long, _parts int")
    place = F.col("_task") + F.least(F.floor((F.col("id") - F.col("_low")) / F.col("_width")), F.col("_parts") - 1).cast("int")
    joined = lookup_join(rows, bounds, [key], salt_on="id")
    return joined.repartitionById(max(1, tasks), place).sortWithinPartitions(key, "id").select(*rows.columns)


def write_windows(rows: DataFrame, path: str, size_ms: int, spans: DataFrame | None = None) -> None:
    """Write every window of ``rows`` (from ``scans.range_readings``) in one pass, as zstd Parquet.

    Only the windows present in ``rows`` are replaced, so running an export again gives the same files. With ``spans``
    (from ``aggregates.window_spans`` over the same readings) nothing is sampled.
    """
    (
        _arranged(rows.withColumn("partition_start", times.window_start(F.col("ts_utc"), size_ms)), "partition_start", spans)
        .select("ts_utc", "ts_received_utc", "plc_name", "tag_name", "value", "value_text", "quality", "partition_start")
        .write.partitionBy("partition_start").option("compression", "zstd")
        .option("maxRecordsPerFile", ROWS_PER_FILE).option("partitionOverwriteMode", "dynamic")
        .mode("overwrite").parquet(path)
    )


def _write_csv(rows: DataFrame, path: str, mode: str, spans: DataFrame | None) -> None:
    """``plc_name`` is both a column of the file and, as ``plc``, the folder of the controller."""
    sorted_rows = _arranged(rows, "plc_name", spans)
    (
        sorted_rows.select(F.col("plc_name").alias("plc"), *scans.csv_columns(sorted_rows))
        .write.partitionBy("plc").option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", ROWS_PER_FILE).option("partitionOverwriteMode", "dynamic")
        .mode(mode).csv(path)
    )


def write_rolling_csv(rows: DataFrame, path: str, spans: DataFrame | None = None) -> None:
    """Replace each controller's CSV; controllers without rows keep the files they have."""
    _write_csv(rows, path, "overwrite", spans)


def write_window_csv(rows: DataFrame, path: str, spans: DataFrame | None = None) -> None:
    """A one-off CSV of a time window; an existing export is never overwritten."""
    _write_csv(rows, path, "errorifexists", spans)


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").parquet(path)
