from pyspark.sql import functions as F

from tidemark.session import cut_lineage, release


def test_a_released_table_is_gone_and_nothing_else(spark, folder):
    kept, gone = cut_lineage(spark.range(5)), cut_lineage(spark.range(7).withColumn("part", F.col("id") % 2))
    path = folder("other")
    spark.range(3).write.parquet(path)
    from_gone = cut_lineage(gone.filter("part = 1"))
    release(gone)
    release(spark.read.parquet(path))
    assert kept.count() == 5 and from_gone.count() == 3 and spark.read.parquet(path).count() == 3
    assert not spark._jvm.java.io.File(gone.inputFiles()[0].removeprefix("file:")).exists()
    release(cut_lineage(spark.range(0)))


def test_a_cut_leaves_the_setting_as_it_was(spark):
    from tidemark.session import SHUFFLE_CLEANUP

    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    shuffled = cut_lineage(spark.range(1000).repartition(5).groupBy("id").count())
    assert shuffled.count() == 1000 and spark.conf.get(SHUFFLE_CLEANUP, "false") == before
