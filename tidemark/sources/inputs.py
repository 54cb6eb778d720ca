"""Readers. Every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark import schemas


def notifications(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw value changes as a batch."""
    return spark.read.format(fmt).schema(schemas.RAW_NOTIFICATIONS).load(path)


def notification_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Raw value changes as a stream of files dropped into a folder."""
    reader = spark.readStream.format(fmt).schema(schemas.RAW_NOTIFICATIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def selection_stream(spark: SparkSession, path: str) -> DataFrame:
    """Changes of the tag selection as they are published to a folder."""
    return spark.readStream.schema(schemas.SELECTION).parquet(path)


def readings(spark: SparkSession, path: str) -> DataFrame:
    """The stored readings, partitioned by UTC date in ``dt``."""
    schema = T.StructType([*schemas.READINGS.fields, T.StructField("dt", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def address_edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Hierarchical references of every controller: one row per parent and child."""
    return spark.read.format(fmt).schema(schemas.ADDRESS_EDGES).load(path)


def site_documents(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Configuration documents of a fleet; a file holds one per line or a single indented one."""
    return spark.read.schema(schemas.SITE_DOCUMENT).option("multiLine", not one_per_line).json(path)


def exported_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a CSV export back; ``plc_name`` also is the folder name and is taken from the file."""
    return (
        spark.read.schema(schemas.EXPORTED_CSV).option("header", True).option("escape", '"')
        .option("multiLine", True).option("recursiveFileLookup", True).csv(path)
    )


def exported_windows(spark: SparkSession, path: str) -> DataFrame:
    """Read exported windows back, with the window start from the folder name."""
    schema = T.StructType([*schemas.EXPORTED_PARQUET.fields, T.StructField("partition_start", T.LongType())])
    return spark.read.schema(schema).parquet(path)
