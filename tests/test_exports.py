"""Scans and exported files: range ends, bytes on disk, read-back, hot controllers, idempotence."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import scans
from tidemark.plans import exports as plans
from tidemark.sinks import exports, state
from tidemark.sources import inputs

HOUR = 3_600_000


@pytest.fixture(scope="module")
def store(spark):
    plcs = [(1, "P1", "opc.tcp://a", "None"), (2, "P,2", "opc.tcp://b", "None"), (3, "EMPTY", "opc.tcp://c", "None")]
    tags = [(10, 1, "n10", "A.x", "Double", None, None, "", "", 1, 1), (20, 2, "n20", 'B."q"', "Double", None, None, "", "", 1, 1)]
    readings = [
        (1, 10, 0, 5, 1.0, None, 0), (2, 10, HOUR, None, None, " lead, and\nbreak", 2), (3, 20, 2 * HOUR, 7, 1e16, None, 1),
        (4, 20, 2 * HOUR - 1, 7, None, None, 0), (5, 99, 0, 7, 1.0, None, 0),
    ]
    return (
        spark.createDataFrame(readings, schemas.READINGS), spark.createDataFrame(tags, schemas.TAGS),
        spark.createDataFrame(plcs, schemas.PLCS),
    )


def test_closed_and_half_open_ranges(store):
    closed = scans.export_rows_in_range(*store, HOUR, 2 * HOUR)
    assert rows(closed, "id") == [(2,), (3,), (4,)]
    assert rows(scans.export_rows_in_range(*store, HOUR, 2 * HOUR, plc_id=2), "id") == [(3,), (4,)]
    assert rows(scans.range_readings(*store, HOUR, 2 * HOUR), "id") == [(2,), (4,)]


def test_readings_of_unknown_tags_drop_out(store):
    assert rows(scans.export_rows(*store), "id") == [(1,), (2,), (3,), (4,)]


def test_stored_scan_prunes_dates(spark, store, folder):
    path = folder("readings")
    exports.write_readings(store[0].withColumn("ts_utc", F.col("ts_utc") + F.col("id") * 86_400_000), path)
    scan = scans.in_range(inputs.readings(spark, path), 2 * 86_400_000, 3 * 86_400_000, closed=False)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(ts_utc)" in plan
    assert rows(scan, "id") == [(2,)]


def text_of(path):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/**/*.csv", recursive=True)))


def test_csv_bytes(store, folder):
    path = folder("csv")
    exports.write_rolling_csv(scans.export_rows(*store), path)
    head = b"timestamp_utc,plc_name,tag_name,value,quality\n"
    assert text_of(f"{path}/plc=P1") == (
        head + b"1970-01-01T00:00:00.000Z,P1,A.x,1,Good\n"
        b'1970-01-01T01:00:00.000Z,P1,A.x," lead, and\nbreak",Bad\n'
    )
    assert text_of(f"{path}/plc=P,2") == (
        head + b'1970-01-01T02:00:00.000Z,"P,2","B.""q""",1E+16,Uncertain\n'
        b'1970-01-01T01:59:59.999Z,"P,2","B.""q""",,Good\n'
    )


def test_csv_read_back(spark, store, folder):
    path = folder("csv")
    exports.write_rolling_csv(scans.export_rows(*store), path)
    back = inputs.exported_csv(spark, path).fillna("")
    named = scans.export_rows(*store)
    assert rows(back) == rows(named.select(*scans.csv_columns(named)))


def test_rolling_csv_leaves_absent_controllers_alone(spark, store, folder):
    path = folder("csv")
    exports.write_rolling_csv(scans.export_rows(*store), path)
    before = text_of(f"{path}/plc=P,2")
    only_first = store[0].filter(F.col("tag_id") == 10).filter(F.col("id") == 1)
    exports.write_rolling_csv(scans.export_rows(only_first, *store[1:]), path)
    assert text_of(f"{path}/plc=P,2") == before
    assert b"Bad" not in text_of(f"{path}/plc=P1")


def test_window_csv_is_never_overwritten_and_checks_its_range(store, folder):
    path = folder("csv")
    stats = plans.window_csv(*store, path, "S", 0, HOUR)
    assert rows(stats, "plc_name", "row_count", "file_name") == [("P1", 2, "S-P1-197001010000_197001010100.csv")]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        plans.window_csv(*store, path, "S", 0, HOUR)
    with pytest.raises(ValueError, match="must end after"):
        plans.window_csv(*store, folder("csv"), "S", HOUR, HOUR)


def test_window_parquet_is_zstd_and_repeatable(spark, store, folder):
    path = folder("windows")
    for _ in range(2):
        exports.write_windows(scans.range_readings(*store, 0, 10 * HOUR), path, 2 * HOUR)
    files = glob.glob(f"{path}/partition_start=*/*.parquet")
    assert sorted(os.path.basename(os.path.dirname(f)) for f in files) == ["partition_start=0", "partition_start=7200000"]
    meta = pq.ParquetFile(files[0]).metadata
    assert meta.row_group(0).column(0).compression == "ZSTD"
    back = inputs.exported_windows(spark, path).drop("partition_start")
    assert rows(back) == rows(scans.range_readings(*store, 0, 10 * HOUR).drop("id"))


def test_a_hot_controller_is_cut_into_files_of_consecutive_ids(spark, store, folder, monkeypatch):
    path = folder("csv")
    many = spark.range(1, 20_001).select(
        F.col("id"), F.lit(10).alias("tag_id"), F.col("id").alias("ts_utc"), F.lit(None).cast("long").alias("ts_received_utc"),
        F.col("id").cast("double").alias("value"), F.lit(None).cast("string").alias("value_text"), F.lit(0).alias("quality"),
    ).repartition(8)
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"  # tiny test data would end in one file
    spark.conf.set(coalescing, "false")
    try:
        exports.write_rolling_csv(scans.export_rows(many, *store[1:]), path)
    finally:
        spark.conf.set(coalescing, "true")
    files = sorted(glob.glob(f"{path}/plc=P1/*.csv"))
    spans = []
    for file in files:
        ids = [int(line.split(",")[3]) for line in open(file).read().splitlines()[1:]]
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
    assert len(files) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sum(b - a + 1 for a, b in spans) == 20_000


def test_state_versions(spark, folder):
    root = folder("settings")
    assert state.read_latest(spark, root, schemas.SETTINGS).count() == 0
    for version, value in ((1, "a"), (2, "b"), (2, "c")):
        state.write_version(spark.createDataFrame([("k", value)], schemas.SETTINGS), root, version)
    os.makedirs(f"{root}/version={3:012d}")  # a write that never finished
    assert rows(state.read_latest(spark, root, schemas.SETTINGS)) == [("k", "c")]
    assert state.write_next(spark.createDataFrame([("k", "d")], schemas.SETTINGS), root) == 3
    state.drop_old_versions(spark, root, keep=1)
    assert state.versions(spark, root) == [3] and rows(state.read_latest(spark, root, schemas.SETTINGS)) == [("k", "d")]


def test_snapshot_counts_the_copy(spark, store, folder):
    readings, tags, plcs = store
    settings = spark.createDataFrame([], schemas.SETTINGS)
    tables = {"readings": readings, "tags": tags, "plcs": plcs, "settings": settings}
    summary, after = plans.snapshot_watermark(tables, folder("snapshot"), delivered=True)
    assert rows(summary) == [("plcs", 3, None), ("readings", 5, 5), ("settings", 0, None), ("tags", 2, None)]
    assert rows(after) == [("backup_uploaded_reading_id", "5")]
    assert rows(plans.snapshot_watermark(tables, folder("snapshot"), delivered=False)[1]) == []


def test_slices_share_or_split_tasks():
    spans = [("a", 10, 0, 99), ("b", 10, 5, 50), ("c", 95, 0, 94), ("d", 1, 7, 7), ("e", 39, 0, 10**12)]
    dealt, tasks = exports.slices(spans, 20)
    assert dealt == [("a", 0, 0, 100, 1), ("b", 0, 5, 46, 1), ("c", 1, 0, 19, 5), ("d", 6, 7, 1, 1), ("e", 7, 0, 5 * 10**11 + 1, 2)] and tasks == 9
    assert exports.slices([], 20) == ([], 0)


def test_a_job_scans_the_readings_twice(spark, folder):
    """Every scan calls the counter once per row: once for the statistics, once for the files."""
    tags = spark.createDataFrame([(t, 1 + t % 2, f"n{t}", f"t{t}", "Double", None, None, "", "", 1, 1) for t in range(6)], schemas.TAGS)
    plcs = spark.createDataFrame([(1, "P1", "opc.tcp://p", "None"), (2, "P2", "opc.tcp://q", "None")], schemas.PLCS)
    data = [(i, 0 if i < 300 else i % 6, i * 60_000, None, float(i), None, 0) for i in range(1, 601)]  # a hot tag
    path = folder("readings")
    exports.write_readings(spark.createDataFrame(data, schemas.READINGS), path)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        seen.add(1)
        return True

    readings = inputs.readings(spark, path).filter(counted(F.col("id")))
    csv, windows = folder("csv"), folder("windows")
    plans.window_csv(readings, tags, plcs, csv, "S", 0, 10**9).collect()
    assert seen.value == 2 * 600
    seen.value = 0
    settings = spark.createDataFrame([("parquet_export_cursor", "60000")], schemas.SETTINGS)
    none = spark.createDataFrame([], schemas.UPLOAD_OUTCOMES)
    run = plans.partition_cycle(
        inputs.readings(spark, path).filter("id > 0").filter(counted(F.col("id"))), tags, plcs, spark.createDataFrame([], schemas.PARTITIONS),
        settings, none, windows, "S", 12 * HOUR, hours=2,
    )
    found = {r["partition_start"]: (r["row_count"], r["max_reading_id"]) for r in run.exported.collect()}
    assert found == {h * HOUR: (min(600, 60 * h + 119) - max(1, 60 * h) + 1, min(600, 60 * h + 119)) for h in range(0, 12, 2)}
    assert seen.value <= 2 * 600 + 1200  # the oldest reading is asked for where nothing lies before the cursor
    for start in found:
        stamps = [r[0] for f in sorted(glob.glob(f"{windows}/partition_start={start}/*.parquet")) for r in spark.read.parquet(f).select("ts_utc").collect()]
        assert stamps == sorted(stamps) and len(stamps) == found[start][0]


def _scanned(df):
    """Rows that left the files, by the metrics of the plan that ran."""
    df.collect()
    todo, counts = [df._jdf.queryExecution().executedPlan()], {}
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            metric = node.metrics().apply("numOutputRows")
            counts[metric.id()] = metric.value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(counts.values())


def test_scans_leave_row_groups_unread(spark, folder):
    plcs = spark.createDataFrame([(p, f"P{p}", "opc.tcp://p", "None") for p in range(10)], schemas.PLCS)
    tags = spark.createDataFrame([(t, t // 10, f"n{t}", f"t{t}", "Double", None, None, "", "", 1, 1) for t in range(100)], schemas.TAGS)
    data = spark.range(20_000).selectExpr(
        "id", "cast(id % 100 AS int) AS tag_id", "id * 30000 AS ts_utc", "cast(NULL AS long) AS ts_received_utc",
        "cast(id AS double) AS value", "cast(NULL AS string) AS value_text", "0 AS quality",
    )
    path = folder("readings")
    by_tag = data.withColumn("dt", F.to_date(F.timestamp_millis("ts_utc"))).repartitionByRange(10, "tag_id").sortWithinPartitions("tag_id", "ts_utc")
    by_tag.write.partitionBy("dt").parquet(path)
    stored = inputs.readings(spark, path)
    one = scans.export_rows(stored, tags, plcs, plc_id=3)
    assert one.count() == 2000 and _scanned(scans.export_rows(stored, tags, plcs, plc_id=3)) < 20_000 / 4  # tags of two files a date
    assert scans.export_rows(stored, tags, plcs, plc_id=99).count() == 0
    newest = scans.latest_readings(stored, tags.filter("tag_id <> 99"), 5)
    assert [r["id"] for r in newest.collect()] == [19_998, 19_997, 19_996, 19_995, 19_994]
    assert _scanned(scans.latest_readings(stored, tags, 5)) < 20_000 / 3
    late = data.filter("id < 2").withColumn("id", F.col("id") + 50_000).withColumn("dt", F.lit("1970-01-01").cast("date"))
    late.write.partitionBy("dt").mode("append").parquet(path)  # the highest ids, on the oldest date
    assert [r["id"] for r in scans.latest_readings(inputs.readings(spark, path), tags, 3).collect()] == [50_001, 50_000, 19_999]
    assert scans.latest_readings(inputs.readings(spark, path), tags, 30_000).count() == 20_002
