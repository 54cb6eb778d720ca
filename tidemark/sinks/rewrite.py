"""Replacing files of a dataset that is written to meanwhile, so that a run that stops can be carried on.

New files are staged beside the dataset, then a journal names the files they replace. From there on the run is bound
to happen: staged files are moved in under names of their own, then the old ones go. Each step can be repeated, and files
that others add are never touched. Between the two steps a reader can meet a row twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.sinks import state

STAGE = "-prune"


@dataclass(frozen=True)
class StoredFile:
    uri: str
    day: str
    size: int


def stored_files(spark: SparkSession, path: str) -> list[StoredFile]:
    """The data files of a dataset by date, as the driver lists them for a scan."""
    found = state._file_system(spark, path).globStatus(state._path(spark, f"{path}/dt=*/*.parquet")) or []
    return [StoredFile(f.getPath().toUri().toString(), f.getPath().getParent().getName()[3:], f.getLen()) for f in found]


def read_files(spark: SparkSession, path: str, uris: list[str]) -> DataFrame:
    """The readings in some files of the dataset at ``path``; no other file is opened."""
    schema = T.StructType([*schemas.READINGS.fields, T.StructField("dt", T.DateType())])
    jvm = spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString() for uri in uris]
    return spark.read.schema(schema).option("basePath", path).parquet(*paths)


def replace(spark: SparkSession, path: str, uris: list[str], kept: DataFrame | None, tasks: int | None = None) -> None:
    """Put the rows of ``kept`` (with ``dt``) in the place of the files, sorted so that statistics prune by tag and time."""
    if kept is not None:
        order = ["dt", "tag_id", "ts_utc"]
        dealt = kept.repartitionByRange(tasks, *order) if tasks else kept.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.partitionBy("dt").mode("overwrite").parquet(f"{path}{STAGE}/kept")
    spark.createDataFrame([(uri,) for uri in uris], "file string").write.parquet(f"{path}{STAGE}/journal")
    finish(spark, path)


def finish(spark: SparkSession, path: str) -> None:
    """Carry out what a journal beside the dataset describes; without a complete one, clear what was staged."""
    if state.exists(spark, f"{path}{STAGE}/journal/_SUCCESS"):
        files = state._file_system(spark, path)
        for staged in files.globStatus(state._path(spark, f"{path}{STAGE}/kept/dt=*/part-*")) or []:
            source = staged.getPath()
            folder = state._path(spark, f"{path}/{source.getParent().getName()}")
            files.mkdirs(folder)
            target = spark._jvm.org.apache.hadoop.fs.Path(folder, source.getName())
            if not files.exists(target):
                files.rename(source, target)
        old = [row[0] for row in spark.read.schema("file string").parquet(f"{path}{STAGE}/journal").collect()]
        state.drop_files(spark, old)
        state.drop_empty_folders(spark, sorted({uri.rpartition("/")[0] for uri in old}))
    state.drop_folders(spark, [f"{path}{STAGE}"])


def input_files(rows: DataFrame, condition) -> DataFrame:
    """file, matching, others: how many rows of each file meet a condition, for files with any that do."""
    flagged = rows.select(F.input_file_name().alias("file"), condition.alias("met"))
    counts = flagged.groupBy("file").agg(F.count_if("met").alias("matching"), F.count_if(~F.col("met")).alias("others"))
    return counts.filter(F.col("matching") > 0)
