"""Notification feeds of many sites as one streaming source.

A site drops numbered files: ``<path>/<site>/<number>.parquet``, numbers without gaps from any start on. The source keeps
one position per site, takes a bounded number of files of each site per micro-batch, and waits at a gap, so that a file
that arrives late is neither lost nor read twice. Every file is a partition, read where the task runs.

Positions are compared with the folders by name only: a trigger asks for the next few names of a site, however many
files it has. Paths are those that Arrow's file systems know (local, s3, gs, hdfs); for folders that only Spark can reach,
``inputs.notification_stream`` reads files in order of their time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark import schemas

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(schemas)

NAME = "tidemark_feed"
FILES_PER_TRIGGER = 100


def file_name(number: int) -> str:
    return f"{number:012d}.parquet"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FeedFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FeedReader(DataSourceStreamReader):
    """Positions are {site: [first number, next number]}."""

    def __init__(self, path: str, limit: int, schema: T.StructType):
        self.path, self.limit, self.schema = path.rstrip("/"), limit, schema
        self.position: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The position after this one: for each site as many files as are there without a gap, up to the limit."""
        store, root = _store(self.path)
        position = dict(self.position or {})
        folders = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for folder in sorted(folders, key=lambda f: f.base_name):
            site = folder.base_name
            if folder.type != fs.FileType.Directory or site.startswith((".", "_")):
                continue
            if site not in position:
                names = [f.base_name for f in store.get_file_info(fs.FileSelector(folder.path))]
                numbers = [int(n.partition(".")[0]) for n in names if n.endswith(".parquet") and n.partition(".")[0].isdigit()]
                if not numbers:
                    continue
                position[site] = [min(numbers)] * 2
            first, after = position[site]
            asked = store.get_file_info([f"{folder.path}/{file_name(n)}" for n in range(after, after + self.limit)])
            there = [f.type == fs.FileType.File for f in asked] + [False]
            position[site] = [first, after + there.index(False)]
        self.position = {site: position[site] for site in sorted(position)}
        return self.position

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """The files between two positions. After a restart it is first asked for the last known position, which it takes over."""
        if self.position is None:
            self.position = end
        return [
            FeedFile(f"{self.path}/{site}/{file_name(number)}")
            for site, (first, after) in sorted(end.items()) for number in range(start.get(site, [first, first])[1], after)
        ]

    def read(self, partition: FeedFile) -> Iterator[pa.RecordBatch]:
        store, path = _store(partition.path)
        wanted = to_arrow_schema(self.schema)
        with store.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=wanted.names):
                columns = [batch.column(f.name).cast(f.type, safe=False) for f in wanted]
                yield pa.RecordBatch.from_arrays(columns, names=wanted.names)


class FeedSource(DataSource):
    """Options: ``path``, ``filesPerTrigger`` (of each site)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return schemas.RAW_NOTIFICATIONS

    def streamReader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(self.options["path"], int(self.options.get("filesPerTrigger", FILES_PER_TRIGGER)), schema)


def notification_feed(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Raw value changes of all sites below ``path`` as a stream.

    A trigger that runs once takes one micro-batch of at most ``files_per_trigger`` files a site; a query that runs on, or
    ``processAllAvailable``, takes them all.
    """
    spark.dataSource.register(FeedSource)
    return spark.readStream.format(NAME).option("path", path).option("filesPerTrigger", files_per_trigger).load()
