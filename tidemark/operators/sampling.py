"""Report-by-exception, sampling intervals and bounded queues over a reading history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import window_start
from tidemark.operators.joins import SALTS, lookup_join
from tidemark.operators.shards import TARGET_ROWS, with_previous

WIDE = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def change_only(readings: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """Rows whose value, text or quality differs from the tag's preceding row; the first row stays."""
    watched = ["value", "value_text", "quality"]
    previous = with_previous(readings, "tag_id", "id", watched, target)
    same = F.col("prev").isNotNull()
    for column in watched:
        same = same & F.col(column).eqNullSafe(F.col(f"prev.{column}"))
    return previous.filter(~same).select(*readings.columns)


def sample_latest(readings: DataFrame, interval_ms: int) -> DataFrame:
    """The latest reading per tag and sampling interval, combined before the shuffle.

    Columns of fixed width are the state of a hash aggregation. Those that are not (texts) are fetched by id afterwards, for
    the chosen rows that have any, so neither whole rows nor texts are sorted or kept as state. Ids are unique.
    """
    rest = [f.name for f in readings.schema.fields if f.name not in ("tag_id", "id")]
    wide = [f.name for f in readings.schema.fields if f.name in rest and isinstance(f.dataType, WIDE)]
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in wide], F.lit(False))
    latest = readings.groupBy("tag_id", window_start(F.col("ts_utc"), interval_ms).alias("interval_start")).agg(
        F.max("id").alias("id"), *[F.max_by(c, "id").alias(c) for c in rest if c not in wide], F.max_by(some, "id").alias("_some"),
    )
    if wide:
        texts = readings.filter(some).select("id", *wide)
        asked = latest.filter("_some").select("id")
        fetched = lookup_join(texts, asked, ["id"], "left_semi")
        latest = latest.join(fetched, "id", "left")
    return latest.select("tag_id", "interval_start", *[c for c in readings.columns if c != "tag_id"])


def keep_last(readings: DataFrame, interval_ms: int, queue_size: int, salts: int = SALTS) -> DataFrame:
    """The last ``queue_size`` readings per tag and publishing interval; older ones are discarded.

    Spark limits each group before the shuffle as well, so a hot tag sends at most ``queue_size``
    rows per interval and task. It does so up to a certain size (``spark.sql.optimizer.windowGroupLimitThreshold``); beyond it
    groups are cut by a salt of the id and limited in the pieces first, so that the last task of a hot group gets
    at most ``salts * queue_size`` rows.
    """
    threshold = int(readings.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    rows = readings.withColumn("_interval", window_start(F.col("ts_utc"), interval_ms))
    if queue_size > threshold:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        rows = _newest(rows, ["tag_id", "_interval", "_salt"], queue_size)
    return _newest(rows, ["tag_id", "_interval"], queue_size).select(*readings.columns)


def _newest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("id"))
    return rows.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= n).drop("_rank")
