"""Manifest rules, the partition cycle and retention."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import aggregates, manifests, retention
from tidemark.plans import exports as plans
from tidemark.plans import retention as retention_plan
from tidemark.sinks import exports
from tidemark.sources import inputs

HOUR, DAY = 3_600_000, 86_400_000


def manifest(spark, *lines):
    data = [(start, 1, f"f{start}", 1, top, "t0", up, gone) for start, top, up, gone in lines]
    return spark.createDataFrame(data, schemas.PARTITIONS)


def outcomes(spark, **results):
    return spark.createDataFrame([(name, result, None) for name, result in results.items()] or [], schemas.UPLOAD_OUTCOMES)


def test_exporting_a_window_again_makes_it_pending(spark):
    old = manifest(spark, (0, 5, "t", 1), (1, 9, "t", 0))
    again = spark.createDataFrame([(0, 1, "f0", 7, 12)], "partition_start long, partition_hours int, file_name string, row_count int, max_reading_id long")
    new = manifests.record_partitions(old, again, "t9")
    assert rows(new) == [(0, 1, "f0", 7, 12, "t9", None, 0), (1, 1, "f1", 1, 9, "t0", "t", 0)]
    assert rows(manifests.record_partitions(new, again, "t9")) == rows(new)
    assert rows(manifests.pending_partitions(new)) == [(0, "f0", 12)]


@pytest.mark.parametrize("keep", [False, True])
def test_uploads_stop_at_the_first_failure(spark, keep):
    old = manifest(spark, *[(n, n, None, 0) for n in range(5)])
    sent = outcomes(spark, f0="ok", f1="missing", f2="ok", f3="failed", f4="ok")
    new = manifests.apply_partition_outcomes(old, sent, "t1", keep)
    gone = 0 if keep else 1
    assert rows(new, "partition_start", "uploaded_at", "local_deleted") == [
        (0, "t1", gone), (1, None, 1), (2, "t1", gone), (3, None, 0), (4, None, 0)
    ]


def test_cleanup_takes_only_old_uploaded_files(spark):
    old = manifest(spark, (0, 1, "t", 0), (1, 1, None, 0), (5, 1, "t", 0))
    assert rows(manifests.cleanup_kept(old, 5), "partition_start", "local_deleted") == [(0, 1), (1, 0), (5, 0)]
    assert rows(manifests.cleanup_kept(old, None)) == rows(old)


def export_state(spark, *lines):
    data = [(plc, f"f{plc}", f"d/f{plc}", last, 1, "t0", up, None, status) for plc, last, up, status in lines]
    return spark.createDataFrame(data, schemas.EXPORT_STATE)


def test_recording_a_csv_export(spark):
    old = export_state(spark, (1, 5, 5, "Uploaded"), (2, 5, 5, "Uploaded"), (3, 5, 0, "UploadFailed"), (4, 9, 9, "UploadFailed"))
    fresh = spark.createDataFrame(
        [(1, "f1", "d/f1", 5, 2), (2, "f2", "d/f2", 8, 2), (3, "f3", "d/f3", 8, 2), (4, "f4", "d/f4", 9, 2), (5, "f5", "d/f5", 3, 2)],
        "plc_id int, file_name string, file_path string, last_reading_id long, row_count int",
    )
    new = manifests.record_exports(old, fresh, "t1")
    assert rows(new, "plc_id", "last_reading_id", "uploaded_reading_id", "status") == [
        (1, 5, 5, "Uploaded"), (2, 8, 5, "Pending"), (3, 8, 0, "Pending"), (4, 9, 9, "UploadFailed"), (5, 3, 0, "Pending")
    ]
    done = manifests.apply_export_outcomes(new, outcomes(spark, f2="missing", f3="ok", f4="failed", f5="ok"), "t2")
    assert rows(done, "plc_id", "uploaded_reading_id", "uploaded_at", "status") == [
        (1, 5, None, "Uploaded"), (2, 5, None, "Pending"), (3, 8, "t2", "Uploaded"), (4, 9, None, "UploadFailed"), (5, 0, None, "Pending")
    ]


def test_settings(spark):
    empty = spark.createDataFrame([], schemas.SETTINGS)
    assert aggregates.setting_long(empty, "k").first()[0] == 0
    once = manifests.put_setting(manifests.put_setting(empty, "k", 5), "other", 1)
    assert aggregates.setting_long(manifests.put_setting(once, "k", 7), "k").first()[0] == 7
    assert rows(manifests.put_setting(once, "k", 7)) == [("k", "7"), ("other", "1")]


def history(spark, *lines):
    return spark.createDataFrame([(i, 1, ts, ts, 1.0, None, 0) for i, ts in lines], schemas.READINGS)


@pytest.fixture(scope="module")
def names(spark):
    tags = spark.createDataFrame([(1, 1, "n", "t", "Double", None, None, "", "", 1, 1)], schemas.TAGS)
    return tags, spark.createDataFrame([(1, "P", "opc.tcp://p", "None")], schemas.PLCS)


def test_cycle_exports_only_elapsed_windows_and_advances_over_empty_ones(spark, names, folder):
    readings = history(spark, (1, 0), (2, HOUR), (3, 4 * HOUR), (4, 6 * HOUR + 1))
    empty, settings = manifest(spark).limit(0), spark.createDataFrame([], schemas.SETTINGS)
    path = folder("windows")
    run = plans.partition_cycle(readings, *names, empty, settings, outcomes(spark), path, "S", 6 * HOUR + 5, hours=2)
    assert rows(run.manifest, "partition_start", "row_count", "max_reading_id") == [(0, 2, 2), (4 * HOUR, 1, 3)]
    assert run.cursor == 6 * HOUR
    assert inputs.exported_windows(spark, path).count() == 3
    # a reading that arrives late for an exported window stays out, and is reported
    later = readings.unionByName(history(spark, (5, HOUR + 1), (6, 7 * HOUR)))
    second = plans.partition_cycle(later, *names, run.manifest, run.settings, outcomes(spark), path, "S", 8 * HOUR, hours=2)
    assert rows(second.exported, "partition_start", "row_count") == [(6 * HOUR, 2)]
    late = retention.late_readings(later, run.cursor, 4)
    assert rows(late, "id") == [(5,)] and rows(retention.windows_to_reexport(late, 2 * HOUR)) == [(0, 1)]


def test_cycle_without_readings(spark, names, folder):
    empty, settings = manifest(spark).limit(0), spark.createDataFrame([], schemas.SETTINGS)
    run = plans.partition_cycle(history(spark), *names, empty, settings, outcomes(spark), folder("w"), "S", 9 * HOUR)
    assert rows(run.manifest) == [] and run.cursor == -1


def test_changed_window_size_starts_before_the_cursor(spark):
    settings = manifests.put_setting(spark.createDataFrame([], schemas.SETTINGS), aggregates.EXPORT_CURSOR_KEY, 6 * HOUR)
    span = plans.elapsed_range(history(spark, (1, 0)), settings, 20 * HOUR, 4 * HOUR)
    assert span == (4 * HOUR, 20 * HOUR)


def test_prune_boundaries(spark):
    readings = history(spark, (1, 99), (2, 100), (3, 50), (4, 101))
    assert rows(retention.retained(readings, 100), "id") == [(2,), (4,)]
    assert rows(retention.retained(readings, 100, 1), "id") == [(2,), (3,), (4,)]
    pruned = readings.filter(retention.is_prunable(100, 1))
    assert rows(retention.without_pruned(readings, pruned), "id") == [(2,), (3,), (4,)]


def test_safe_mode_keeps_what_was_never_copied(spark):
    readings = history(spark, (1, 0), (2, HOUR), (9, 1))  # id 9 came after the export of window 0
    windows = manifest(spark, (0, 1, "t", 0), (HOUR, 20, "t", 0))
    plain = retention.retained(readings, 5 * HOUR, 20)
    assert rows(plain, "id") == []
    assert rows(retention.retained_safely(readings, 5 * HOUR, windows), "id") == [(9,)]
    assert rows(retention.retained_safely(readings, 5 * HOUR, windows.limit(0)), "id") == [(1,), (2,), (9,)]


def test_sweep_decisions(spark):
    settings = spark.createDataFrame([], schemas.SETTINGS)
    windows = manifest(spark, (0, 7, "t", 0), (1, 99, None, 0))
    decide = retention.sweep_decision
    assert decide(windows, settings, 100 * DAY, 10, True) == (90 * DAY, 7)
    assert decide(windows.limit(0), settings, 100 * DAY, 10, True) is None
    assert decide(windows.limit(0), settings, 100 * DAY, 10, False) == (90 * DAY, None)
    assert decide(windows, settings, 100 * DAY, 0, True) is None
    backed = manifests.put_setting(settings, aggregates.BACKUP_WATERMARK_KEY, 50)
    assert decide(windows, backed, 100 * DAY, 10, True) == (90 * DAY, 50)


@pytest.mark.parametrize("watermark", [None, 25])
def test_pruning_a_stored_dataset(spark, folder, watermark):
    path = folder("readings")
    readings = history(spark, *[(i, i * DAY // 10) for i in range(1, 61)])  # ten a day, six days
    exports.write_readings(readings, path)
    cutoff = 3 * DAY + DAY // 2
    removed = retention_plan.prune_dataset(spark, path, cutoff, watermark)
    left = inputs.readings(spark, path)
    assert rows(left, "id") == rows(retention.retained(readings, cutoff, watermark), "id")
    assert removed == 60 - left.count()
    days = {str(r[0]) for r in left.select(F.col("dt")).distinct().collect()}
    assert ("1970-01-01" in days) is False
    assert retention_plan.prune_dataset(spark, path, cutoff, watermark) == 0
