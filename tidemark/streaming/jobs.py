"""Starting the streaming jobs. Every job checkpoints, so each row is stored exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.times import HOUR_MS, utc_date, window_start
from tidemark.operators import registry
from tidemark.operators.registry import resolve_notifications
from tidemark.plans.fleet import normalise
from tidemark.sinks import state
from tidemark.sources import inputs
from tidemark.streaming.processors import BUCKETS, selected_stream

ROWS_PER_TASK = 500_000


def trigger(once: bool, seconds: float = 1.0) -> dict:
    """All that is available, or a micro-batch per interval."""
    return {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}


def resolved_stream(raw: DataFrame, tags: DataFrame, plcs: DataFrame) -> DataFrame:
    return normalise(resolve_notifications(raw, tags, plcs))


def start_ingest(
    raw: DataFrame, tags: DataFrame, plcs: DataFrame, path: str, checkpoint: str,
    default_deadband: float = 0.0, exempt_boolean: bool = False, once: bool = False,
    rows_per_task: int = ROWS_PER_TASK, buckets: int = BUCKETS, seconds: float = 1.0,
    on_types: Callable[[DataFrame], None] | None = None, changes: DataFrame | None = None,
) -> StreamingQuery:
    """Raw notifications to stored readings: tag lookup, normalising, deadband, Parquet by date.

    A micro-batch is appended as a plain batch write, so the dataset stays one that other jobs can
    prune. Only the first batch after a start can be a repetition of one that was already written;
    its rows are compared by id with what its dates hold. A batch is written by as many tasks as its rows
    ask for, each file sorted by tag and time. ``on_types`` is handed
    tag_id, data_type and id of each batch that stored something.

    The tags and controllers are the selection that a new checkpoint starts with; it goes into the stream's state. Later
    selections come as a stream of ``changes`` (``schemas.SELECTION``) and take effect with the next micro-batch.
    """
    stored = selected_stream(normalise(raw), registry.selection(tags, plcs), changes, default_deadband, exempt_boolean, buckets)
    may_repeat = [True]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("dt", utc_date(F.col("ts_utc"))).persist()
        fresh = _not_stored(rows, path) if may_repeat else rows
        tasks = -(-rows.count() // rows_per_task)
        if tasks:
            if tasks > 1:
                fresh = fresh.repartitionByRange(tasks, "dt", "tag_id", "ts_utc")
            else:
                fresh = fresh.coalesce(1)
            fresh.sortWithinPartitions("dt", "tag_id", "ts_utc").write.mode("append").partitionBy("dt").parquet(path)
            if on_types is not None:
                on_types(rows.select("tag_id", "data_type", "id"))
        rows.unpersist()
        may_repeat.clear()

    return (
        stored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger(once, seconds)).start()
    )


def _not_stored(rows: DataFrame, path: str) -> DataFrame:
    if not state.exists(rows.sparkSession, path):
        return rows
    days = [row[0] for row in rows.select("dt").distinct().collect()]  # the dates of one micro-batch
    stored = inputs.readings(rows.sparkSession, path).filter(F.col("dt").isin(days)).select("id")
    return rows.join(stored, "id", "left_anti")


def closed_windows(readings: DataFrame, hours: int, lateness: str) -> DataFrame:
    """Row count and highest id per window, emitted once the watermark has passed its end.

    Rows that come later than ``lateness`` behind the newest one are not counted; ``figures.start_window_report``
    counts the same windows and names those rows in the same stream.
    """
    return (
        readings.withColumn("ts", F.timestamp_millis("ts_utc")).withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{hours} hours"))
        .agg(F.count("*").alias("row_count"), F.max("id").alias("max_reading_id"))
        .select(F.unix_millis("window.start").alias("partition_start"), "row_count", "max_reading_id")
    )


def start_append(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger(once)).start()
    )


def start_late_report(
    readings: DataFrame, path: str, checkpoint: str, cursor, hours: int = 6, once: bool = False
) -> StreamingQuery:
    """Append every reading whose window the export cursor had passed when it arrived.

    ``cursor`` is called per micro-batch and returns the cursor in epoch milliseconds; the report
    names the windows to export again.
    """
    size = hours * HOUR_MS

    def write(batch: DataFrame, batch_id: int) -> None:
        late = batch.filter(F.col("ts_utc") < cursor()).persist()
        if not late.isEmpty():
            named = late.withColumn("partition_start", window_start(F.col("ts_utc"), size))
            named.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        late.unpersist()

    return (
        readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**trigger(once)).start()
    )
