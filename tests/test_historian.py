"""The whole life of a history in one folder: register, discover, ingest, export, prune, archive."""

import datetime as dt
import glob

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.historian import Historian
from tidemark.sources import inputs

DAY = 86_400_000
T0 = 1704067200000
TAG = "ns=4;s=|var|P.Application.G."


def test_life_cycle(spark, folder):
    site = Historian(spark, folder("site"), "Plant")
    assert rows(site.latest()) == [] and site.run_retention(T0, 10, upload_enabled=False) == 0

    site.upsert_plcs(spark.createDataFrame([("P", "opc.tcp://p", "None", 1)], "name string, endpoint_url string, security_policy string, seq long"))
    edges = spark.createDataFrame([("P", "i=85", TAG + t, "Variable", t, None) for t in ("a", "b", "c")], schemas.ADDRESS_EDGES)
    site.sync_discovery(edges, T0)
    site.toggle_subtree("G", True)
    chosen = site.table("tags").filter(~F.col("tag_name").endswith(".c")).select("plc_id", "tag_id")
    site.set_tags_enabled(site.table("plcs").select("plc_id"), chosen)
    assert rows(site.table("tags"), "tag_id", "tag_name", "enabled") == [(1, "G.a", 1), (2, "G.b", 1), (3, "G.c", 0)]

    source, checkpoint = folder("feed"), folder("checkpoint")
    start = dt.datetime.fromtimestamp(T0 / 1000, dt.timezone.utc).replace(tzinfo=None)
    feed = []
    for n in range(1, 61):  # three tags in turn, every three hours
        at = start + dt.timedelta(hours=3 * n)
        feed.append(("P", TAG + "abc"[n % 3], at, at, 0, "Double", None, float(n), None, n))
    spark.createDataFrame(feed, schemas.RAW_NOTIFICATIONS).write.parquet(source)
    site.start_ingest(inputs.notification_stream(spark, source), checkpoint, default_deadband=4.0, once=True).awaitTermination()
    ids = [r["id"] for r in site.readings().orderBy("id").collect()]
    assert ids == sorted([n for n in range(1, 61, 6)] + [n for n in range(3, 61, 6)])

    site.register_views()
    newest = spark.sql(
        "SELECT tag_name, timestamp_millis(ts_utc) AS at, value, quality "
        "FROM tags INNER JOIN readings USING (tag_id) ORDER BY id DESC LIMIT 2"
    )
    assert [r["value"] for r in newest.collect()] == [57.0, 55.0] == [r["value"] for r in site.latest(2).collect()]

    sent = []

    def upload(pending):
        for line in pending.collect():
            sent.append(spark.read.parquet(line["folder"]).count() if "folder" in pending.columns else spark.read.csv(line["file_path"], header=True).count())
        return pending.select("file_name", F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("at"))

    first = site.run_partition_cycle(upload, T0 + 5 * DAY, hours=24)
    assert first.cursor == T0 + 5 * DAY
    manifest = site.table("parquet_partitions")
    assert manifest.count() == 5 and manifest.filter("uploaded_at IS NULL OR local_deleted = 0").count() == 0
    assert manifest.orderBy("partition_start").first()["file_name"] == "Plant-20240101T0000Z.parquet"
    assert not glob.glob(f"{site.root}/partitions/partition_start=*")

    def broken(pending):
        raise OSError("no route")

    with pytest.raises(OSError):
        site.run_partition_cycle(broken, T0 + 8 * DAY, hours=24)
    waiting = site.table("parquet_partitions").filter("uploaded_at IS NULL")
    assert waiting.count() == 3 and len(glob.glob(f"{site.root}/partitions/partition_start=*")) == 3
    second = site.run_partition_cycle(upload, T0 + 8 * DAY, hours=24)
    assert second.exported.count() == 0 and sum(sent) == len(ids)
    assert site.table("parquet_partitions").filter("uploaded_at IS NULL OR local_deleted = 0").count() == 0
    assert rows(site.table("tags"), "tag_name", "data_type") == [("G.a", "Double"), ("G.b", "Double"), ("G.c", "Unknown")]

    site.run_rolling_csv(upload, T0 + 8 * DAY)
    assert rows(site.table("export_state"), "file_name", "row_count", "last_reading_id", "status") == [("Plant-P.csv", len(ids), 57, "Uploaded")]
    assert rows(site.run_window_csv(T0, T0 + DAY), "row_count") == [(3,)]

    watermark = manifest.agg(F.max("max_reading_id")).first()[0]
    kept = [r for r in rows(site.readings(), "id", "ts_utc") if not (r[1] < T0 + 6 * DAY and r[0] <= watermark + 1000)]
    removed = site.run_retention(T0 + 9 * DAY, 3, upload_enabled=True)
    assert removed == len(ids) - len(kept) and rows(site.readings(), "id", "ts_utc") == kept
    assert rows(site.plc_health(), "name", "discovered_tags", "monitored_tags") == [("P", 3, 2)]

    summary = site.run_snapshot(T0 + 9 * DAY, delivered=True)
    assert ("readings", len(kept), 57) in rows(summary)
    assert ("backup_uploaded_reading_id", "57") in rows(site.table("settings"))


def test_the_selection_feed_holds_what_changed(spark, folder):
    site = Historian(spark, folder("site"), "Plant")
    site.upsert_plcs(spark.createDataFrame([("P", "opc.tcp://p", "None", 1)], "name string, endpoint_url string, security_policy string, seq long"))
    edges = spark.createDataFrame([("P", "i=85", TAG + t, "Variable", t, None) for t in ("a", "b", "c")], schemas.ADDRESS_EDGES)
    site.sync_discovery(edges, T0)
    chosen = site.table("tags").filter(~F.col("tag_name").endswith(".c")).select("plc_id", "tag_id")
    site.set_tags_enabled(site.table("plcs").select("plc_id"), chosen)
    site.set_tags_enabled(site.table("plcs").select("plc_id"), chosen)  # nothing new
    site.publish_selection()
    feed = spark.read.parquet(f"{site.root}/feeds/selection")
    assert rows(feed, "tag_id", "live", "version") == [(1, True, 1), (2, True, 1), (3, False, 2), (3, True, 1)]

    source, start = folder("feed"), dt.datetime.fromtimestamp(T0 / 1000, dt.timezone.utc).replace(tzinfo=None)
    def notify(*parts):
        spark.createDataFrame([("P", TAG + t, start, start, 0, "Double", None, 1.0, None, n) for t, n in parts], schemas.RAW_NOTIFICATIONS).write.mode("append").parquet(source)

    notify(("a", 1), ("c", 2))
    query = site.start_ingest(inputs.notification_stream(spark, source), folder("checkpoint"), seconds=0.0, buckets=2)
    try:
        query.processAllAvailable()
        other = site.table("tags").filter(F.col("tag_name").endswith(".c")).select("plc_id", "tag_id")
        site.set_tags_enabled(site.table("plcs").select("plc_id"), other)
        query.processAllAvailable()
        notify(("a", 3), ("c", 4))
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(site.readings(), "id") == [(1,), (4,)]


def _filled(spark, folder, hours=40):
    from tidemark.sinks import exports

    site = Historian(spark, folder("site"), "Plant")
    site.upsert_plcs(spark.createDataFrame([("P", "opc.tcp://p", "None", 1)], "name string, endpoint_url string, security_policy string, seq long"))
    site.sync_discovery(spark.createDataFrame([("P", "i=85", TAG + "a", "Variable", "a", None)], schemas.ADDRESS_EDGES), T0)
    data = [(n, 1, T0 + n * 3_600_000, None, float(n), None, 0) for n in range(1, hours)]
    exports.write_readings(spark.createDataFrame(data, schemas.READINGS), f"{site.root}/readings")
    return site


def test_uploads_before_a_failure_stay_recorded(spark, folder):
    site = _filled(spark, folder)

    def half_way(pending):
        for n, row in enumerate(pending.collect()):
            if n == 2:
                raise OSError("the line went down")
            yield row["file_name"], "ok", None

    with pytest.raises(OSError):
        site.run_partition_cycle(half_way, T0 + 2 * DAY, hours=6)
    manifest = site.table("parquet_partitions")
    assert [r[0] for r in rows(manifest.filter("uploaded_at IS NOT NULL"), "partition_start")] == [T0, T0 + 6 * 3_600_000]
    asked = []

    def rest(pending):
        for row in pending.collect():
            asked.append(row["partition_start"])
            yield row["file_name"], "ok", None

    site.run_partition_cycle(rest, T0 + 2 * DAY, hours=6)
    assert asked == [T0 + h * 3_600_000 for h in range(12, 40, 6)]
    assert site.table("parquet_partitions").filter("uploaded_at IS NULL").count() == 0

    def csv_fails(pending):
        yield from ((row["file_name"], "ok", None) for row in pending.collect())
        raise OSError("after the last file")

    with pytest.raises(OSError):
        site.run_rolling_csv(csv_fails, T0 + 2 * DAY)
    assert rows(site.table("export_state"), "plc_id", "status", "uploaded_reading_id") == [(1, "Uploaded", 39)]


def test_what_others_record_during_an_upload_stays(spark, folder):
    """While files are being uploaded another job adds a window of its own and exports one of these again."""
    site = _filled(spark, folder)
    other = T0 - 30 * DAY

    def slow(pending):
        again = site.table("parquet_partitions").filter(F.col("partition_start") == T0).withColumn("exported_at", F.lit("2099-01-01T00:00:00.000Z"))
        new = again.withColumn("partition_start", F.lit(other))
        site.change("parquet_partitions", lambda now: now.filter(F.col("partition_start") != T0).unionByName(again).unionByName(new))
        site.change("export_state", lambda now: now.unionByName(
            spark.createDataFrame([(7, "f", "p", 5, 5, "x", 0, None, "Pending")], schemas.EXPORT_STATE)))
        return pending.selectExpr("file_name", "'ok' AS outcome", "CAST(NULL AS string) AS at")

    site.run_partition_cycle(slow, T0 + 2 * DAY, hours=6, keep=True)
    manifest = {r["partition_start"]: r for r in site.table("parquet_partitions").collect()}
    assert other in manifest and manifest[T0]["exported_at"].startswith("2099") and manifest[T0]["uploaded_at"] is None
    assert manifest[T0 + 6 * 3_600_000]["uploaded_at"] is not None
    site.run_rolling_csv(lambda pending: pending.selectExpr("file_name", "'ok' AS outcome", "CAST(NULL AS string) AS at"), T0 + 2 * DAY)
    assert rows(site.table("export_state"), "plc_id") == [(1,), (7,)]
