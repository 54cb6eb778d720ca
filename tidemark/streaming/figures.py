"""Figures that streams keep: health per controller, the first type per tag, closed windows and late rows.

A processor holds a map of figures per bucket, reads the entries that a micro-batch touches, and emits only those it
changed. Rows are dealt to buckets by key and by a salt of their id, so a controller or a window with most of the rows is
spread over many tasks; each bucket has a part of the figure, and parts are brought together where they are read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.functions.times import HOUR_MS
from tidemark.operators.registry import NULL_TYPE
from tidemark.sinks import changes
from tidemark.streaming.processors import ROCKSDB

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS, SALTS = 32, 8
HEALTH = T.StructType().add("part", "integer").add("plc_name", "string").add("samples", "long").add("last_sample_ms", "long").add("silent", "boolean")
TYPES = T.StructType().add("tag_id", "integer").add("data_type", "string").add("id", "long")
WINDOWS = (T.StructType().add("partition_start", "long").add("row_count", "long").add("max_reading_id", "long")
           .add("id", "long").add("tag_id", "integer").add("ts_utc", "long").add("late", "boolean"))


def _stateful(rows: DataFrame, bucket: Column, processor: StatefulProcessor, schema: T.StructType, time_mode: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.withColumn("bucket", bucket.cast("int")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time_mode,
    )


def _on_event_time(rows: DataFrame, lateness: str) -> DataFrame:
    """Rows that move the watermark without being dropped behind it: what is late is for the processor to say."""
    columns = rows.columns
    return rows.withColumn("_at", F.timestamp_millis("ts_utc")).withWatermark("_at", lateness).select(*columns)


# Health

class HealthProcessor(StatefulProcessor):
    """Rows and last receive time per controller; a timer tells which of them have gone silent."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle):
        self.handle = handle
        self.figures = handle.getMapState("figures", "plc_name string", "samples long, last_ms long, last_ts long, silent boolean")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        fresh = pdf.groupby("plc_name", sort=False).agg(samples=("id", "size"), last_ms=("ts_received_utc", "max"), last_ts=("ts_utc", "max"))
        out = []
        for name, samples, last_ms, last_ts in fresh.itertuples():
            before = self.figures.getValue((name,)) or (0, None, last_ts, False)
            known = [int(x) for x in (before[1], last_ms) if x is not None and x == x]
            entry = (before[0] + int(samples), max(known, default=None), int(max(before[2], last_ts)), False)
            self.figures.updateValue((name,), entry)
            out.append((key[0], name, entry[0], entry[1], False))
        if self.silence_ms:
            self._look_again(timerValues.getCurrentWatermarkInMs())
        yield _frame(out, HEALTH)

    def _look_again(self, now: int) -> None:
        """A bucket is looked through every half of the silence at most, whatever the number of its rows."""
        step = max(1, self.silence_ms // 2)
        self.handle.registerTimer((max(now, 0) // step + 1) * step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out, waiting = timerValues.getCurrentWatermarkInMs(), [], False
        for (name,), (samples, last_ms, last_ts, silent) in list(self.figures.iterator()):
            if not silent and last_ts + self.silence_ms <= now:
                self.figures.updateValue((name,), (samples, last_ms, last_ts, True))
                out.append((key[0], name, samples, last_ms, True))
            waiting |= not silent and last_ts + self.silence_ms > now
        if waiting:
            self._look_again(now)
        yield _frame(out, HEALTH)

    def close(self):
        pass


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=schema.fieldNames())
    whole = {f.name: "Int64" for f in schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))}
    return frame.astype(whole | {f.name: "boolean" for f in schema.fields if isinstance(f.dataType, T.BooleanType)})


def health_changes(readings: DataFrame, silence_ms: int | None = None, lateness: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """part, plc_name, samples, last_sample_ms, silent: the figures that a micro-batch changed, per part of a controller.

    With ``silence_ms`` a controller whose newest row lies so far behind the watermark is emitted once more, as silent.
    """
    rows = readings.select("plc_name", "id", "ts_utc", "ts_received_utc")
    if silence_ms:
        rows = _on_event_time(rows, lateness)
    bucket = F.pmod(F.hash("plc_name") + F.pmod(F.hash("id"), F.lit(SALTS)), F.lit(buckets))
    return _stateful(rows, bucket, HealthProcessor(silence_ms), HEALTH, "EventTime" if silence_ms else "None")


def merge_health(rows: DataFrame) -> DataFrame:
    """The newest row of every part."""
    rest = [c for c in rows.columns if c not in ("part", "plc_name")]
    return rows.groupBy("part", "plc_name").agg(F.max_by(F.struct(*rest), "batch").alias("_")).select("part", "plc_name", "_.*").select(*rows.columns)


def current_health(spark: SparkSession, root: str) -> DataFrame:
    """plc_name, samples, last_sample_ms, silent (all of its parts are)."""
    parts = merge_health(changes.read(spark, root, HEALTH))
    return parts.groupBy("plc_name").agg(
        F.sum("samples").alias("samples"), F.max("last_sample_ms").alias("last_sample_ms"), F.bool_and("silent").alias("silent")
    )


# Types

HELD_TAGS = 500_000


def _firsts(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The row of the lowest id of every tag."""
    return pd.concat(parts, ignore_index=True).sort_values(["tag_id", "id"], ignore_index=True).drop_duplicates("tag_id")


def _firsts_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle a task's rows are brought to one per tag, or to a few where it has very many tags."""
    held, n = [], 0
    for batch in batches:
        held.append(_firsts([batch]))
        n += len(held[-1])
        if n > HELD_TAGS:
            held = [_firsts(held)]
            n = len(held[0])
            if n > HELD_TAGS // 2:
                yield held[0]
                held, n = [], 0
    if held:
        yield _firsts(held)


class FirstTypeProcessor(StatefulProcessor):
    """The type of each tag's lowest id; what has not been asked for in a while may be forgotten."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.first = handle.getMapState("first", "tag_id int", "id long, data_type string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _firsts(list(rows))
        out = []
        for tag, kind, reading in zip(pdf["tag_id"].tolist(), pdf["data_type"], pdf["id"].tolist(), strict=True):
            before = self.first.getValue((tag,))
            if before is None or reading < before[0]:
                self.first.updateValue((tag,), (reading, kind))
                out.append((tag, kind, reading))
        yield _frame(out, TYPES)

    def close(self):
        pass


def type_changes(readings: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """tag_id, data_type, id of each reading that is the first known of its tag to have a value.

    With ``ttl_ms`` a tag's state is dropped that long after it was written; the tag is then named again, with a higher
    id, which changes nothing in the table. A task sends one row per tag on, so a tag needs no salt however many rows it has.
    """
    rows = readings.filter(F.col("data_type") != NULL_TYPE).select(F.col("tag_id").cast("int").alias("tag_id"), "data_type", "id")
    rows = rows.mapInPandas(_firsts_of_task, rows.schema)
    bucket = F.pmod(F.hash("tag_id"), F.lit(buckets))
    return _stateful(rows, bucket, FirstTypeProcessor(ttl_ms), TYPES, "ProcessingTime" if ttl_ms else "None")


def merge_types(rows: DataFrame) -> DataFrame:
    """The row of the lowest id of every tag."""
    rest = [c for c in rows.columns if c != "tag_id"]
    return rows.groupBy("tag_id").agg(F.min_by(F.struct(*rest), "id").alias("_")).select("tag_id", "_.*").select(*rows.columns)


def current_types(spark: SparkSession, root: str) -> DataFrame:
    return merge_types(changes.read(spark, root, TYPES)).select("tag_id", "data_type")


def start_changes(
    df: DataFrame, root: str, merge: changes.Merge, checkpoint: str, trigger: dict, fold_every: int = 200,
) -> StreamingQuery:
    """Keep a table of ``df``'s changes; every ``fold_every`` micro-batches they are folded to one row per key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        changes.write(batch, root, batch_id)
        if batch_id % fold_every == fold_every - 1:
            changes.fold(batch.sparkSession, root, df.schema, merge)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


# Windows

class WindowProcessor(StatefulProcessor):
    """Counts per window until the watermark passes its end; rows that come later are named one by one."""

    def __init__(self, size_ms: int):
        self.size_ms = size_ms

    def init(self, handle):
        self.handle = handle
        self.open = handle.getMapState("open", "partition_start long", "row_count long, max_reading_id long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        start = (pdf["ts_utc"] // self.size_ms * self.size_ms).to_numpy()
        late = start + self.size_ms <= timerValues.getCurrentWatermarkInMs()
        windows, of = np.unique(start[~late], return_inverse=True)
        counts = np.bincount(of, minlength=len(windows))
        highest = np.full(len(windows), np.iinfo(np.int64).min)
        np.maximum.at(highest, of, pdf["id"].to_numpy()[~late])
        for window, count, high in zip(windows.tolist(), counts.tolist(), highest.tolist(), strict=True):
            before = self.open.getValue((window,))
            if before is None:
                self.handle.registerTimer(window + self.size_ms)
            else:
                count, high = count + before[0], max(high, before[1])
            self.open.updateValue((window,), (count, high))
        behind = pdf.loc[late]
        out = [(s, None, None, i, tag, ts, True) for s, i, tag, ts in zip(start[late].tolist(), *(behind[c].tolist() for c in ("id", "tag_id", "ts_utc")), strict=True)]
        yield _frame(out, WINDOWS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        window = expiredTimerInfo.getExpiryTimeInMs() - self.size_ms
        figures = self.open.getValue((window,))
        self.open.removeKey((window,))
        yield _frame([(window, *figures, None, None, None, False)] if figures else [], WINDOWS)

    def close(self):
        pass


def window_report(readings: DataFrame, hours: int, lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """Parts of closed windows (partition_start, row_count, max_reading_id) and late rows (partition_start, id, tag_id, ts_utc, late).

    A window closes in all buckets in the same micro-batch, as they share the watermark. Every row is counted in a closed
    window, waits in an open one, or is named as late, never two of these.
    """
    rows = _on_event_time(readings.select("id", F.col("tag_id").cast("int").alias("tag_id"), "ts_utc"), lateness)
    return _stateful(rows, F.pmod(F.hash("id"), F.lit(buckets)), WindowProcessor(hours * HOUR_MS), WINDOWS, "EventTime")


def start_window_report(
    readings: DataFrame, root: str, checkpoint: str, trigger: dict, hours: int = 6, lateness: str = "1 hour", buckets: int = BUCKETS,
    on_late: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Closed windows to ``root/closed`` and late rows to ``root/late``, a folder per micro-batch that has any.

    ``on_late`` is handed the late rows of a micro-batch, to have their windows exported again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        closed = rows.filter(~F.col("late")).groupBy("partition_start").agg(
            F.sum("row_count").alias("row_count"), F.max("max_reading_id").alias("max_reading_id")
        )
        late = rows.filter("late").select("partition_start", "id", "tag_id", "ts_utc")
        for part, name in ((closed, "closed"), (late, "late")):
            if not part.isEmpty():
                part.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
                if name == "late" and on_late is not None:
                    on_late(part)
        rows.unpersist()

    report = window_report(readings, hours, lateness, buckets)
    return report.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
