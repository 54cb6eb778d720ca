"""The feed source: positions, gaps, bounded micro-batches, restarts."""

import datetime as dt
import os

import pytest
from helpers import rows

from tidemark import schemas
from tidemark.sources import feeds

AT = dt.datetime(2024, 1, 1)


@pytest.fixture()
def drop(spark, folder, tmp_path):
    """Puts a numbered file of a site in place, as a site would: written elsewhere, then renamed."""
    root = str(tmp_path / "feeds")

    def put(site, number, *seqs):
        staged = folder("staged")
        notes = [("P", "n", None if n % 2 else AT, AT, 0, "Double", None, float("nan") if n == 5 else float(n), None, n) for n in seqs]
        spark.createDataFrame(notes, schemas.RAW_NOTIFICATIONS).coalesce(1).write.parquet(staged)
        os.makedirs(f"{root}/{site}", exist_ok=True)
        part = next(f for f in os.listdir(staged) if f.startswith("part-"))
        os.rename(f"{staged}/{part}", f"{root}/{site}/{feeds.file_name(number)}")

    put.root = root
    return put


def run(spark, root, path, checkpoint, limit=2):
    """All that is there, and the number of rows of each micro-batch."""
    query = (
        feeds.notification_feed(spark, root, limit).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    )
    try:
        query.processAllAvailable()
        return [p.numInputRows for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()


def test_restarts_lose_and_repeat_nothing(spark, drop, folder):
    path, checkpoint = folder("out"), folder("checkpoint")
    os.makedirs(drop.root)
    assert run(spark, drop.root, path, checkpoint) == []
    for n in range(7, 12):  # numbers may begin anywhere
        drop("a", n, n)
    drop("b", 0, 100, 101)
    assert run(spark, drop.root, path, checkpoint) == [4, 2, 1]  # two files of each site at a time
    assert run(spark, drop.root, path, checkpoint) == []
    drop("a", 13, 13)  # waits for number 12
    drop("b", 1, 102)
    drop("c", 5, 200)
    assert run(spark, drop.root, path, checkpoint) == [2]
    drop("a", 12, 12)
    assert run(spark, drop.root, path, checkpoint, limit=1) == [1, 1]
    stored = spark.read.parquet(path)
    assert rows(stored, "seq") == [(n,) for n in [7, 8, 9, 10, 11, 12, 13, 100, 101, 102, 200]]
    first = stored.filter("seq = 8").first()
    assert first["source_ts"] == first["received_ts"] and first["v_num"] == 8.0 and stored.filter("seq = 7").first()["source_ts"] is None


def test_a_planned_batch_is_run_again_with_the_same_files(drop):
    reader = feeds.FeedReader(drop.root, 2, schemas.RAW_NOTIFICATIONS)
    drop("a", 0, 1)
    end = reader.latestOffset()
    drop("a", 1, 2)
    again = feeds.FeedReader(drop.root, 2, schemas.RAW_NOTIFICATIONS)
    assert [p.path for p in again.partitions({}, end)] == [f"{drop.root}/a/{feeds.file_name(0)}"]
    assert again.latestOffset() == {"a": [0, 2]} and [p.path for p in again.partitions(end, {"a": [0, 2]})] == [f"{drop.root}/a/{feeds.file_name(1)}"]
    assert again.partitions(end, end) == []
