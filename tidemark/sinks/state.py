"""State tables as immutable versions: each run writes a new one, readers take the newest complete one."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_version(table: DataFrame, root: str, version: int) -> str:
    """Write one version. A run that is repeated with the same number replaces its own output."""
    target = f"{root}/version={version:012d}"
    table.write.mode("overwrite").parquet(target)
    return target


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions whose write completed (the committer leaves a marker file), oldest first."""
    found = _file_system(spark, root).globStatus(_path(spark, f"{root}/version=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in (found or []))


def _claim(spark: SparkSession, root: str, version: int) -> bool:
    """Take a version number; False if another writer has it. The file is created exclusively."""
    path = _path(spark, f"{root}/claims/{version:012d}")
    try:
        _file_system(spark, root).create(path, False).close()
    except Py4JJavaError as taken:
        if _file_system(spark, root).exists(path):
            return False
        raise taken
    return True


def update(
    spark: SparkSession, root: str, schema, change: Callable[[DataFrame], DataFrame], patience: float = 600.0
) -> int:
    """Write the version after the newest one as ``change`` of the newest one; returns its number.

    Two writers never get the same number, and none builds on a version that another one is replacing:
    who finds the next number taken waits for that version and starts again from it. A number whose
    version does not appear within ``patience`` seconds belongs to a writer that died and is passed over.
    """
    while True:
        version = max(versions(spark, root), default=0)
        number = version + 1
        while not _claim(spark, root, number):
            give_up = time.monotonic() + patience
            while time.monotonic() < give_up and max(versions(spark, root), default=0) < number:
                time.sleep(0.2)
            if max(versions(spark, root), default=0) >= number:
                break
            number += 1
        else:
            write_version(change(read_latest(spark, root, schema)).select(*schema.fieldNames()), root, number)
            return number


def write_next(table: DataFrame, root: str) -> int:
    """Write ``table`` as the version after the newest one."""
    return update(table.sparkSession, root, table.schema, lambda _: table)


def read_version(spark: SparkSession, root: str, version: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/version={version:012d}")


def read_latest(spark: SparkSession, root: str, schema) -> DataFrame:
    """The newest version, or an empty table before the first one."""
    found = versions(spark, root)
    return read_version(spark, root, found[-1], schema) if found else spark.createDataFrame([], schema)


def drop_old_versions(spark: SparkSession, root: str, keep: int = 10) -> None:
    """Remove all but the newest versions; a reader pinned to an older one loses it."""
    old = versions(spark, root)[:-keep]
    drop_folders(spark, [f"{root}/{name}{version:012d}" for version in old for name in ("version=", "claims/")])


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def drop_files(spark: SparkSession, uris: list[str]) -> None:
    """Remove files named by their URIs; those that are gone already are passed over."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def drop_empty_folders(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders in which no data files are left; a folder that gets one meanwhile is not removed."""
    for path in paths:
        files, folder = _file_system(spark, path), _path(spark, path)
        if files.exists(folder) and not [f for f in files.listStatus(folder) if not f.getPath().getName().startswith((".", "_"))]:
            files.delete(folder, True)


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _file_system(spark, path).delete(_path(spark, path), True)
