"""Streams give the batch result however the input is split, and survive a restart."""

import datetime as dt
import random
from collections import Counter

import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import sampling
from tidemark.plans import fleet
from tidemark.sinks import changes
from tidemark.sources import inputs
from tidemark.streaming import figures, jobs, processors

HOUR = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 1)


def notification(seq, node="n1", value=None, flag=None, text=None, status=0, at=None, source=True):
    at = at or T0 + dt.timedelta(minutes=seq)
    kind = "Boolean" if flag is not None else "String" if text is not None else "Double"
    return ("P", node, at if source else None, at + dt.timedelta(seconds=1), status, kind, flag, value, text, seq)


@pytest.fixture(scope="module")
def dims(spark):
    tags = [(1, 1, "n1", "t1", "Unknown", None, 5.0, "", "", 1, 1), (2, 1, "n2", "t2", "Unknown", None, None, "", "", 1, 1),
            (3, 1, "off", "t3", "Unknown", None, None, "", "", 1, 0)]
    plcs = spark.createDataFrame([(1, "P", "opc.tcp://p", "None")], schemas.PLCS)
    return spark.createDataFrame(tags, schemas.TAGS), plcs


FEED = [
    notification(1, value=10.0), notification(2, value=12.0), notification(3, value=15.0), notification(4, value=99.0, status=0x80000000),
    notification(5, "n2", text="a"), notification(6, "n2", text="a"), notification(7, "off", value=1.0), notification(8, value=None),
    notification(9, value=19.9, source=False), notification(10, value=20.0), notification(11, flag=True), notification(12, value=float("nan")),
    notification(13, value=0.5), notification(14, "n2", text="b"), notification(15, value=5.4), notification(16, value=5.5),
]


def feed(spark, path, part):
    spark.createDataFrame(part, schemas.RAW_NOTIFICATIONS).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("cuts", [[], [5], [1, 2, 9, 13]])
def test_ingest_in_pieces_with_a_restart_before_each(spark, dims, folder, cuts):
    source, path, checkpoint = folder("feed"), folder("readings"), folder("checkpoint")
    bounds = [0, *cuts, len(FEED)]
    for start, stop in zip(bounds, bounds[1:]):
        feed(spark, source, FEED[start:stop])
        raw = inputs.notification_stream(spark, source)
        jobs.start_ingest(raw, *dims, path, checkpoint, default_deadband=0.0, once=True).awaitTermination()
    stored = inputs.readings(spark, path)
    batch = fleet.ingest(spark.createDataFrame(FEED, schemas.RAW_NOTIFICATIONS), *dims)
    assert rows(stored, "id") == rows(batch, "id") == [(1,), (3,), (4,), (5,), (6,), (8,), (10,), (11,), (12,), (13,), (14,), (16,)]
    assert rows(stored.drop("dt"), *schemas.READINGS.fieldNames()) == rows(batch, *schemas.READINGS.fieldNames())


def test_a_repeated_batch_is_not_stored_twice(spark, dims, folder):
    """A run that died after its write but before its commit leaves rows that the next run meets again."""
    source, path = folder("feed"), folder("readings")
    feed(spark, source, FEED)
    for attempt in range(2):
        raw = inputs.notification_stream(spark, source)
        jobs.start_ingest(raw, *dims, path, folder("checkpoint"), once=True).awaitTermination()
    batch = fleet.ingest(spark.createDataFrame(FEED, schemas.RAW_NOTIFICATIONS), *dims)
    assert rows(inputs.readings(spark, path), "id") == rows(batch, "id")


def test_receive_time_stands_in_for_a_missing_source_time(spark, dims):
    raw = spark.createDataFrame([FEED[8]], schemas.RAW_NOTIFICATIONS)
    row = fleet.normalise(raw).first()
    assert row["ts_utc"] == row["ts_received_utc"]


def readings_stream(spark, dims, source, files=None):
    return jobs.resolved_stream(inputs.notification_stream(spark, source, files_per_trigger=files), *dims)


def test_change_only_across_micro_batches(spark, dims, folder):
    source, path, checkpoint = folder("feed"), folder("changed"), folder("checkpoint")
    for part in (FEED[:5], FEED[5:6], FEED[6:]):
        feed(spark, source, part)
    stream = readings_stream(spark, dims, source, files=1).drop("plc_name", "node_id")
    jobs.start_append(processors.change_stream(stream), path, checkpoint, once=True).awaitTermination()
    batch = sampling.change_only(jobs.resolved_stream(spark.createDataFrame(FEED, schemas.RAW_NOTIFICATIONS), *dims))
    assert rows(spark.read.parquet(path), "id") == rows(batch, "id")
    assert (6,) not in rows(batch, "id")


class CountedState:
    """A map state that counts what is asked of it."""

    def __init__(self, entries):
        self.entries, self.reads, self.writes = dict(entries), 0, 0

    def getValue(self, key):
        self.reads += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self.entries[key] = value


class CountedHandle:
    def __init__(self, entries):
        self.state = CountedState(entries)

    def getMapState(self, *_):
        return self.state


def counted(processor, entries, pdf):
    handle = CountedHandle(entries)
    processor.init(handle)
    out = pd.concat(list(processor.handleInputRows((0,), iter([pdf]), None)), ignore_index=True)
    return out, handle.state


def test_a_batch_reads_the_entries_of_its_own_tags(spark):
    """Ten thousand tags share the bucket; three are in the batch, and one of them changes its state."""
    base = {"value_text": None, "quality": 0, "is_nan": False, "bucket": 0, "band": 5.0}
    pdf = pd.DataFrame([
        {"id": 1, "tag_id": 7, "value": 50.0, "gated": True, **base}, {"id": 2, "tag_id": 7, "value": 51.0, "gated": True, **base},
        {"id": 3, "tag_id": 8, "value": 1.0, "gated": True, **base}, {"id": 4, "tag_id": 9, "value": 9.0, "gated": False, **base},
    ])
    out, state = counted(processors.DeadbandProcessor(), {(t,): (0.0,) for t in range(10_000)}, pdf)
    assert out["id"].tolist() == [1, 4] and (state.reads, state.writes) == (2, 1) and state.entries[(7,)] == (50.0,)

    rows_of = {(t,): (1.0, False, None, 0) for t in range(10_000)}
    out, state = counted(processors.ChangeProcessor(), rows_of, pdf.drop(columns=["gated", "band"]))
    assert out["id"].tolist() == [1, 2, 4] and (state.reads, state.writes) == (3, 2)

    nodes = {("P", f"n{t}"): (t, t != 9, 5.0, 0, 0.0, True) for t in range(10_000)}
    named = pdf.assign(plc_name="P", node_id="n" + pdf["tag_id"].astype(str), changed=False, countable=True, ts_utc=0, ts_received_utc=0, data_type="Double")
    out, state = counted(processors.SelectionProcessor(), nodes, named.drop(columns=["tag_id"]))
    assert out[["id", "tag_id"]].values.tolist() == [[1, 7]] and (state.reads, state.writes) == (3, 1)


def test_a_change_of_the_selection_reaches_a_running_stream(spark, dims, folder):
    tags, plcs = dims
    source, feed_path, path = folder("feed"), folder("selection"), folder("readings")
    feed(spark, source, FEED[:2])
    spark.createDataFrame([], schemas.SELECTION).write.parquet(feed_path)

    def select(node, tag, live, band, version):
        spark.createDataFrame([("P", node, tag, live, band, version)], schemas.SELECTION).coalesce(1).write.mode("append").parquet(feed_path)

    raw = inputs.notification_stream(spark, source)
    query = jobs.start_ingest(raw, tags, plcs, path, folder("checkpoint"), seconds=0.0, buckets=4, changes=inputs.selection_stream(spark, feed_path))
    try:
        query.processAllAvailable()
        select("n1", 1, False, 5.0, 3)  # off
        select("off", 3, True, None, 3)  # on
        select("n2", 2, False, None, -1)  # older than the selection that the stream began with
        query.processAllAvailable()
        feed(spark, source, [notification(20, value=90.0), notification(21, "off", value=1.0), notification(22, "n2", text="a")])
        query.processAllAvailable()
        select("n1", 1, True, 50.0, 4)  # on again, with a wider band, from the last stored value
        select("n1", 1, False, 5.0, 3)
        query.processAllAvailable()
        feed(spark, source, [notification(30, value=59.0), notification(31, value=60.0), notification(32, value=90.0)])
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(inputs.readings(spark, path), "id") == [(1,), (21,), (22,), (31,)]


def test_only_closed_windows_are_emitted(spark, dims, folder):
    source, path, checkpoint = folder("feed"), folder("closed"), folder("checkpoint")
    feed(spark, source, [notification(1, value=1.0, at=T0), notification(2, value=1.0, at=T0 + 2 * HOUR)])
    feed(spark, source, [notification(3, value=1.0, at=T0 + 4 * HOUR - HOUR / 60)])
    windows = jobs.closed_windows(readings_stream(spark, dims, source), hours=2, lateness="0 seconds")
    jobs.start_append(windows, path, checkpoint, once=True).awaitTermination()
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert rows(spark.read.parquet(path)) == [(start, 1, 1)]


def test_running_health_writes_what_a_batch_changed(spark, dims, folder):
    source, root, checkpoint = folder("feed"), folder("health"), folder("checkpoint")
    for part, total in ((FEED[:4], 4), (FEED[4:], 15)):
        feed(spark, source, part)
        health = figures.health_changes(readings_stream(spark, dims, source), buckets=4)
        figures.start_changes(health, root, figures.merge_health, checkpoint, jobs.trigger(True)).awaitTermination()
        assert rows(figures.current_health(spark, root), "plc_name", "samples", "silent") == [("P", total, False)]
    written = rows(changes.read(spark, root, figures.HEALTH).groupBy("batch").count())
    assert len(written) == 2 and all(n <= 4 for _, n in written)


def test_a_fold_changes_nothing_and_removes_folders(spark, dims, folder):
    source, checkpoint, plain, folded = folder("feed"), folder("checkpoint"), folder("plain"), folder("folded")
    for n in range(0, 16, 2):
        feed(spark, source, FEED[n : n + 2])
    for root, every in ((plain, 1000), (folded, 2)):
        health = figures.health_changes(readings_stream(spark, dims, source, files=1), buckets=4)
        figures.start_changes(health, root, figures.merge_health, f"{checkpoint}{every}", jobs.trigger(True), every).awaitTermination()
    assert rows(figures.current_health(spark, plain)) == rows(figures.current_health(spark, folded))
    assert changes._numbers(spark, plain, "changes/batch") == list(range(8)) and changes._numbers(spark, folded, "changes/batch") == [6, 7]
    assert changes._numbers(spark, folded, "folded/upto") == [5, 7]


def test_silent_controllers_are_named_by_a_timer(spark, folder):
    source, root = folder("feed"), folder("silent")
    schema = "plc_name string, id long, ts_utc long, ts_received_utc long"
    minute = 60_000
    for part in ([("A", 1, 0, 1), ("B", 2, 0, None)], [("A", 3, 30 * minute, 5)], [("A", 4, 61 * minute, 6)], [("A", 6, 61 * minute, 6)], [("B", 5, 62 * minute, 7)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    health = figures.health_changes(stream, silence_ms=60 * minute, lateness="0 seconds", buckets=2)
    figures.start_changes(health, root, figures.merge_health, folder("checkpoint"), jobs.trigger(True)).awaitTermination()
    said = changes.read(spark, root, figures.HEALTH).filter("silent")
    assert ("B", 1) in rows(said, "plc_name", "samples")
    assert rows(figures.current_health(spark, root)) == [("A", 4, 6, False), ("B", 2, 7, False)]


def test_first_type_is_the_lowest_id_with_a_value(spark, dims, folder):
    source, root, checkpoint = folder("feed"), folder("types"), folder("checkpoint")
    feed(spark, source, [FEED[7], FEED[10], notification(20, value=1.0)])
    feed(spark, source, [FEED[4], notification(21, text="x"), notification(9, value=2.0)])
    feed(spark, source, [notification(22, text="x")])
    types = figures.type_changes(readings_stream(spark, dims, source, files=1), buckets=1)
    figures.start_changes(types, root, figures.merge_types, checkpoint, jobs.trigger(True)).awaitTermination()
    assert rows(figures.current_types(spark, root)) == [(1, "Double"), (2, "String")]
    assert rows(changes.read(spark, root, figures.TYPES), "batch", "tag_id") == [(0, 1), (1, 1), (1, 2)]


def test_every_row_is_in_a_closed_window_or_named_as_late(spark, folder):
    source, root = folder("feed"), folder("report")
    random.seed(7)
    stamps = [random.randrange(0, 100 * 3_600_000) for _ in range(400)]
    schema = "id long, tag_id int, ts_utc long"
    table = [(i, i % 5, ts) for i, ts in enumerate(stamps)] + [(1000, 0, 500 * 3_600_000)]
    for part in (table[:150], table[150:220], table[220:400], table[400:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    handed = []
    figures.start_window_report(
        stream, root, folder("checkpoint"), jobs.trigger(True), hours=4, lateness="10 hours", buckets=3, on_late=lambda late: handed.append(late.count())
    ).awaitTermination()
    closed, late = spark.read.parquet(f"{root}/closed"), spark.read.parquet(f"{root}/late")
    size, wanted, highest, behind, mark = 4 * 3_600_000, Counter(), {}, [], 0
    for start, stop in ((0, 150), (150, 220), (220, 400)):
        for i, _, ts in table[start:stop]:
            window = ts // size * size
            if window + size <= mark:
                behind.append((i,))
            else:
                wanted[window] += 1
                highest[window] = max(i, highest.get(window, 0))
        mark = max(ts for _, _, ts in table[:stop]) - 10 * 3_600_000
    assert rows(late, "id") == sorted(behind) and len(behind) > 50 and sum(handed) == len(behind)
    assert rows(closed, "partition_start", "row_count", "max_reading_id") == sorted((w, n, highest[w]) for w, n in wanted.items())
    assert sum(wanted.values()) + len(behind) == 400


def test_late_report(spark, dims, folder):
    source, path, checkpoint = folder("feed"), folder("late"), folder("checkpoint")
    feed(spark, source, [notification(1, value=1.0, at=T0), notification(2, value=1.0, at=T0 + 7 * HOUR)])
    cursor = int((T0 + 6 * HOUR).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    stream = readings_stream(spark, dims, source).select("id", "ts_utc")
    jobs.start_late_report(stream, path, checkpoint, lambda: cursor, once=True).awaitTermination()
    assert rows(spark.read.parquet(path), "id") == [(1,)]


def test_keep_last_and_sampling(spark):
    readings = spark.createDataFrame([(i, 1 + i % 2, i * 10, None, float(i), None, 0) for i in range(1, 31)], schemas.READINGS)
    kept = sampling.keep_last(readings, 100, 2)
    assert rows(kept.filter(F.col("tag_id") == 1), "id") == [(6,), (8,), (16,), (18,), (26,), (28,), (30,)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle, once after
    latest = sampling.sample_latest(readings, 100)
    assert rows(latest.filter(F.col("tag_id") == 1), "interval_start", "id") == [(0, 8), (100, 18), (200, 28), (300, 30)]


def test_sampling_keeps_no_rows_as_state(spark):
    text = [(i, 1 + i % 2, i * 10, None, None if i % 3 else float(i), f"t{i}" if i % 3 else None, 0) for i in range(1, 31)]
    readings = spark.createDataFrame(text, schemas.READINGS)
    latest = sampling.sample_latest(readings, 100)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert rows(latest.filter("tag_id = 1"), "id", "value", "value_text") == [(8, None, "t8"), (18, 18.0, None), (28, None, "t28"), (30, 30.0, None)]


def test_a_large_queue_of_a_hot_interval_is_cut(spark):
    readings = spark.range(200_000).selectExpr("id", "cast(id div 1000000 AS int) AS tag_id", "id AS ts_utc", "id AS ts_received_utc", "0D AS value", "'' AS value_text", "0 AS quality")
    kept = sampling.keep_last(readings, 10**9, 5000)
    assert kept.agg(F.count("*"), F.min("id")).first() == (5000, 195_000)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(tag_id") >= 2 and "_salt" in plan
