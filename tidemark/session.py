"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a setting of Spark's

def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes.

    Times are epoch milliseconds in UTC, so the session zone is pinned. AQE stays on: it
    coalesces small shuffles and splits skewed join partitions at run time.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests, benches and small jobs; clusters bring their own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Every executor must reach it, so a machine-local folder is made only when the whole session
    lives on one machine (a ``local`` master) and names none.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tidemark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, for a table another job reads back."""
    return os.path.join(shared_root(spark), f"{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a plan that reads it back.

    The copy outlives the executors that made it, is compressed, and is read column by column. Tables of whole
    texts are smaller with ``compression`` "zstd" than as the session compresses.
    """
    path = shared_dir(df.sparkSession, "table")
    with shuffles_removed(df.sparkSession):
        (df.write if compression is None else df.write.option("compression", compression)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs that write a table remove their shuffle files when they end, and not when the driver collects its garbage.

    What reads the table later needs none of them.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def release(df: DataFrame) -> None:
    """Delete the table that ``cut_lineage`` wrote for ``df``, once all that was made from it is written itself."""
    spark = df.sparkSession
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    for folder in folders:
        if folder.rpartition("/")[2].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
