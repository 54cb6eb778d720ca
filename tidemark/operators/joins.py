"""Joining the large side of the data to a smaller one without assuming the small side is small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_SETTING = "tidemark.broadcastBytes"  # a session may raise or lower the bound
SALTS = 32
BINS = 1 << 14  # keys are counted by their hash
HOT_SHARE = 512  # a bin with more than this fraction of the rows is spread; at most so many bins are


def measured_bytes(df: DataFrame) -> int:
    """The size of ``df`` by adding up its rows: 8 bytes a fixed field, the text length otherwise."""
    sizes = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(field.name), F.lit(0)) + 16)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    row_bytes = reduce(lambda a, b: a + b, sizes)
    return df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_on: str | None = None,
    dim_bytes: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``dim``, whose keys are unique, keeping ``facts`` on the left.

    ``dim`` is measured first. Within the bound it is broadcast, so ``facts`` is not shuffled at
    all. Beyond it both sides are shuffled on the key, and hot keys are spread by a salt taken from ``salt_on``
    (a column that varies within a key), so that one key holding a third of the facts lies in many tasks. Only
    the rows of ``dim`` that hot keys can meet are repeated, once per salt. Streams are not counted: there the
    trigger bounds what a key puts into a task. ``dim_bytes`` is the size when the caller has just measured it.
    """
    if dim_bytes is None:
        dim_bytes = measured_bytes(dim)
    if dim_bytes <= int(facts.sparkSession.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES))):
        return facts.join(F.broadcast(dim), on, how)
    hot = [] if salt_on is None or facts.isStreaming else hot_bins(facts, on)
    if not hot:
        return facts.join(dim, on, how)
    salt = F.when(_bin(facts, on).isin(hot), F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(_bin(facts, on).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = dim.withColumn("_salt", F.explode(salts))
    return facts.withColumn("_salt", salt).join(spread, [*on, "_salt"], how).drop("_salt")


def _bin(facts: DataFrame, on: list[str]) -> Column:
    """The bin of a row's key, on either side: keys have the types that they have in ``facts``."""
    return F.pmod(F.xxhash64(*[F.col(c).try_cast(facts.schema[c].dataType) for c in on]), F.lit(BINS)).cast("int")


def hot_bins(facts: DataFrame, on: list[str]) -> list[int]:
    """The bins that hold more than one part in ``HOT_SHARE`` of all rows; a bin's count is all that is moved."""
    counts = facts.groupBy(_bin(facts, on).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # BINS rows at most
    whole = sum(row.n for row in counts)
    return sorted(row.bin for row in counts if row.n * HOT_SHARE > whole)


def tag_lookup(tags: DataFrame, plcs: DataFrame) -> DataFrame:
    """One row per tag with its controller: the dimension side of every export scan.

    Both inputs are dimensions, so how to join them is left to Spark.
    """
    names = plcs.select("plc_id", F.col("name").alias("plc_name"))
    return tags.select("tag_id", "plc_id", "tag_name").join(names, "plc_id")


def named_readings(readings: DataFrame, tags: DataFrame, plcs: DataFrame) -> DataFrame:
    """Readings with their tag and controller names; readings of unknown tags drop out."""
    return lookup_join(readings, tag_lookup(tags, plcs), ["tag_id"], salt_on="id")


def plcs_with_tags(plcs: DataFrame, tags: DataFrame) -> DataFrame:
    """Controllers that have at least one tag, whether or not anything was read from it.

    The tag side is reduced to distinct ids before the join, so a controller holding most tags
    costs no more than any other.
    """
    return plcs.join(tags.select("plc_id").distinct(), "plc_id", "left_semi")


def latest_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: the row with the highest ``order`` per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), order).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, object]) -> DataFrame:
    """Merge ``new`` into ``old`` by key; both sides hold one row per key.

    ``rules`` gives each remaining column its value in terms of ``o`` (old row) and ``n`` (new row);
    a column without a rule takes the new value where there is a new row, else the old one.
    """
    joined = (
        old.withColumn("_old", F.lit(True)).alias("o")
        .join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")
    )
    values = []
    for column in old.columns:
        if column in keys:
            values.append(F.col(column))
        elif column in rules:
            values.append(rules[column].alias(column))
        else:
            merged = F.when(F.col("n._new"), F.col(f"n.{column}")).otherwise(F.col(f"o.{column}"))
            values.append(merged.alias(column))
    return joined.select(*values)


def inserted() -> Column:
    """Inside an upsert rule: the key had no old row."""
    return F.col("o._old").isNull()


def touched() -> Column:
    """Inside an upsert rule: the key has a new row."""
    return F.col("n._new").isNotNull()
