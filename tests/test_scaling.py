"""Work that must not grow faster than the input: repeated dimension rows, plans evaluated twice, files of one task."""

import os

import pandas as pd
from pyspark.sql import functions as F

from checks import fixtures
from tidemark import schemas
from tidemark.operators import deadband, discovery, joins
from tidemark.session import cut_lineage
from tidemark.sinks import state
from tidemark.streaming import figures


def test_only_hot_keys_are_repeated_per_salt(spark):
    facts = spark.range(15_000).select("id", F.when(F.col("id") < 5000, F.lit(1)).otherwise(F.col("id")).alias("k"))
    assert len(joins.hot_bins(facts, ["k"])) == 1
    dim = spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("name"))  # another type of key
    spark.conf.set(joins.BROADCAST_SETTING, "0")
    try:
        met = joins.lookup_join(facts, dim, ["k"], salt_on="id")
        assert met.count() == 15_000 and "_salt" in met._jdf.queryExecution().optimizedPlan().toString()
        even = joins.lookup_join(facts.filter("id >= 5000"), dim, ["k"], salt_on="id")
        assert even.count() == 10_000 and "_salt" not in even._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(joins.BROADCAST_SETTING)


def test_readings_are_computed_once_for_the_deadband(spark):
    text = [(i, 1 + i % 2, i * 10, None, float(i), None, 0) for i in range(1, 31)]
    readings = spark.createDataFrame(text, schemas.READINGS).rdd.toDF(schemas.READINGS)
    tags = spark.createDataFrame([(1, 5.0)], "tag_id int, deadband_override double")
    kept = deadband.deadband(readings, tags)
    assert "LogicalRDD" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.filter("tag_id = 2").count() == 15 and kept.filter("tag_id = 1").count() < 15


def test_references_are_computed_once_for_discovery(spark):
    edges = spark.sparkContext.parallelize([("p", "i=85", "ns=4;s=|var|M.Application.a", "Variable", "a", None)]).toDF(schemas.ADDRESS_EDGES)
    found = discovery.discover_tags(edges)
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 1


def test_a_task_sends_one_row_per_tag(spark):
    batches = [pd.DataFrame({"tag_id": [1, 1, 2], "data_type": ["b", "a", "c"], "id": [5, 3, 4]}), pd.DataFrame({"tag_id": [1], "data_type": ["d"], "id": [1]})]
    sent = pd.concat(list(figures._firsts_of_task(iter(batches))))
    assert sorted(sent.itertuples(index=False, name=None)) == [(1, "d", 1), (2, "c", 4)]


def test_pieces_of_a_stream_have_the_same_number_of_files(spark, folder, monkeypatch):
    monkeypatch.setattr(fixtures, "FILE_ROWS", 40)
    path, rows = folder("pieces"), spark.range(300).withColumnRenamed("id", "seq")
    pieces = [rows.filter("seq < 100"), rows.filter("seq < 0"), rows.filter("seq >= 100")]
    assert fixtures.Tables(spark, "")._in_turn(path, pieces, 100) == 3
    assert len(state._file_system(spark, path).globStatus(state._path(spark, f"{path}/part-*"))) == 9
    assert spark.read.parquet(path).count() == 300


def test_tables_of_texts_are_compressed_as_asked(spark):
    files = cut_lineage(spark.range(3), "zstd").inputFiles()
    assert files and all("zstd" in os.path.basename(f) for f in files)
