"""Versions of state tables: one writer per number, no lost change."""

import threading

from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import manifests
from tidemark.plans.historian import Historian
from tidemark.sinks import state


def test_changes_of_two_writers_both_stay(spark, folder):
    site = Historian(spark, folder("site"))
    site.put_setting("a", 0)
    begun, go_on = threading.Event(), threading.Event()

    def slow(settings):
        begun.set()
        go_on.wait(30)
        return manifests.put_setting(settings, "a", 1)

    first = threading.Thread(target=lambda: site.change("settings", slow))
    first.start()
    begun.wait(30)
    second = threading.Thread(target=lambda: site.put_setting("b", 2))
    second.start()
    go_on.set()
    first.join()
    second.join()
    assert rows(site.table("settings")) == [("a", "1"), ("b", "2")]
    assert state.versions(spark, f"{site.root}/tables/settings") == [1, 2, 3]


def test_a_dead_writers_number_is_passed_over(spark, folder):
    root = folder("table")
    assert state._claim(spark, root, 1) and not state._claim(spark, root, 1)
    table = spark.createDataFrame([("k", "v")], schemas.SETTINGS)
    assert state.update(spark, root, schemas.SETTINGS, lambda _: table, patience=0.5) == 2
    assert rows(state.read_latest(spark, root, schemas.SETTINGS)) == [("k", "v")]


def test_snapshot_and_cycle_interleaved_keep_both_settings(spark, folder, monkeypatch):
    from tidemark.plans import exports

    site = Historian(spark, folder("site"))
    copy = exports.snapshot

    def meanwhile(tables, path):
        site.put_setting("parquet_export_cursor", 77)
        return copy(tables, path)

    monkeypatch.setattr(exports, "snapshot", meanwhile)
    site.run_snapshot(5, delivered=True)
    assert rows(site.table("settings")) == [("backup_uploaded_reading_id", "0"), ("parquet_export_cursor", "77")]


def test_old_versions_and_their_numbers_go(spark, folder):
    root = folder("table")
    table = spark.createDataFrame([("k", "v")], schemas.SETTINGS)
    for _ in range(4):
        state.write_next(table, root)
    state.drop_old_versions(spark, root, keep=2)
    assert state.versions(spark, root) == [3, 4] and state.write_next(table.withColumn("value", F.lit("w")), root) == 5


def _store(spark, ids, path):
    from tidemark.sinks import exports

    data = [(i, 1, i * 3_600_000, None, float(i), None, 0) for i in ids]
    exports.write_readings(spark.createDataFrame(data, schemas.READINGS), path)


def test_prune_goes_on_where_it_stopped(spark, folder, monkeypatch):
    """Stop before the removals, let a late reading arrive, and run again: nothing is lost, nothing is twice."""
    from tidemark.plans import retention
    from tidemark.sources import inputs

    path = folder("readings")
    _store(spark, range(1, 60), path)
    drop = state.drop_files
    monkeypatch.setattr(state, "drop_files", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    try:
        retention.prune_dataset(spark, path, 30 * 3_600_000)
        raise AssertionError("it did not stop")
    except OSError:
        pass
    _store(spark, [25], path + "-late")
    late = inputs.readings(spark, path + "-late").withColumn("id", F.lit(100).cast("long"))
    late.write.partitionBy("dt").mode("append").parquet(path)
    monkeypatch.setattr(state, "drop_files", drop)
    retention.finish_prune(spark, path)
    assert [r[0] for r in rows(inputs.readings(spark, path), "id")] == [*range(30, 60), 100]
    retention.finish_prune(spark, path)
    assert retention.prune_dataset(spark, path, 30 * 3_600_000) == 1
    assert [r[0] for r in rows(inputs.readings(spark, path), "id")] == list(range(30, 60))


def test_prune_drops_whole_dates_and_unfinished_stages(spark, folder):
    import glob

    from tidemark.plans import retention
    from tidemark.sources import inputs

    path = folder("readings")
    _store(spark, range(1, 60), path)
    _store(spark, [1], f"{path}-prune/kept")  # a stage without a journal
    assert retention.prune_dataset(spark, path, 48 * 3_600_000) == 47
    assert [r[0] for r in rows(inputs.readings(spark, path), "id")] == list(range(48, 60))
    assert [f.rpartition("/")[2] for f in sorted(glob.glob(f"{path}/dt=*"))] == ["dt=1970-01-03"] and not glob.glob(f"{path}-prune")


def _many_files(spark, path, ids, files):
    data = [(i, i % 3, i * 3_600_000, None, float(i), None, 0) for i in ids]
    frame = spark.createDataFrame(data, schemas.READINGS).withColumn("dt", F.to_date(F.timestamp_millis("ts_utc")))
    frame.repartition(files, "id").write.partitionBy("dt").mode("append").parquet(path)


def test_small_files_of_closed_dates_become_few(spark, folder):
    import glob

    from tidemark.plans import retention
    from tidemark.sources import inputs

    path = folder("readings")
    assert retention.compact_dataset(spark, path, 10**12) == (0, 0)
    _many_files(spark, path, range(96), 60)  # four dates
    count = lambda day: len(glob.glob(f"{path}/dt=1970-01-0{day}/*.parquet"))
    open_date = count(4)
    assert min(count(day) for day in (1, 2, 3)) > 10
    before, after = retention.compact_dataset(spark, path, 72 * 3_600_000)
    assert before > 30 and after <= 6 and sum(count(day) for day in (1, 2, 3)) == after and count(4) == open_date
    stored = inputs.readings(spark, path)
    assert rows(stored, "id", "tag_id", "value") == [(i, i % 3, float(i)) for i in range(96)]
    first = spark.read.parquet(sorted(glob.glob(f"{path}/dt=1970-01-01/*.parquet"))[0])
    found = [(r["tag_id"], r["ts_utc"]) for r in first.collect()]
    assert found == sorted(found)
    assert retention.compact_dataset(spark, path, 72 * 3_600_000) == (0, 0)  # nothing left to pack


def test_a_compaction_goes_on_where_it_stopped(spark, folder, monkeypatch):
    """Stopped after half of the moves and before the removals, while more rows of an old date come in."""
    from tidemark.plans import retention
    from tidemark.sources import inputs

    path = folder("readings")
    _many_files(spark, path, range(96), 40)
    drop = state.drop_files
    monkeypatch.setattr(state, "drop_files", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    try:
        retention.compact_dataset(spark, path, 10**12)
        raise AssertionError("it did not stop")
    except OSError:
        pass
    _many_files(spark, path, [200], 1)
    monkeypatch.setattr(state, "drop_files", drop)
    assert retention.prune_dataset(spark, path, 0) == 0  # any job on the dataset carries on first
    assert [r[0] for r in rows(inputs.readings(spark, path), "id")] == [*range(96), 200]
    assert not state.exists(spark, f"{path}-prune")
