"""Tables that a stream keeps current by what each micro-batch changed.

``root/changes/batch=N`` holds the rows of micro-batch N. Now and then what is older is folded into
``root/folded/upto=N``, one row per key, and its folders go. ``merge`` tells how rows of one key are brought
together; folded rows and changes are the same to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sinks import state

Merge = Callable[[DataFrame], DataFrame]


def _numbers(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The numbers of complete folders, lowest first."""
    found = state._file_system(spark, root).globStatus(state._path(spark, f"{root}/{kind}=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in (found or []))


def write(batch: DataFrame, root: str, batch_id: int) -> None:
    """The rows of one micro-batch; a repetition replaces them."""
    batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")


def read(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All rows that count, with the number of their micro-batch in ``batch``."""
    wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    folds = _numbers(spark, root, "folded/upto")
    newer = [n for n in _numbers(spark, root, "changes/batch") if not folds or n > folds[-1]]
    parts = [spark.read.schema(wide).parquet(f"{root}/folded/upto={folds[-1]}")] if folds else []
    if newer:
        folders = [f"{root}/changes/batch={n}" for n in newer]
        parts.append(spark.read.schema(wide).option("basePath", f"{root}/changes").parquet(*folders))
    if not parts:
        return spark.createDataFrame([], wide)
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def fold(spark: SparkSession, root: str, schema: T.StructType, merge: Merge) -> None:
    """Bring all rows so far to one per key, and remove what the fold before this one made superfluous."""
    numbers, folds = _numbers(spark, root, "changes/batch"), _numbers(spark, root, "folded/upto")
    if not numbers or (folds and numbers[-1] <= folds[-1]):
        return
    merge(read(spark, root, schema)).write.mode("overwrite").parquet(f"{root}/folded/upto={numbers[-1]}")
    old = [f"{root}/changes/batch={n}" for n in numbers if folds and n <= folds[-1]]  # readers may still be at the others
    state.drop_folders(spark, [*old, *(f"{root}/folded/upto={n}" for n in folds[:-1])])
