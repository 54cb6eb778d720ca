"""Thinning a reading history with a per-tag deadband, exactly and in parallel.

What is stored depends on the last *stored* value, so a tag is a sequential chain. Ordinary tags
run as one chain each inside a task that streams sorted Arrow batches. A hot tag is cut into bounded
shards of consecutive ids (see ``shards``) and handled in three steps:

1. every shard is summarised, independently, by what it does to an unknown last stored value;
2. the summaries of a tag are chained, in groups of bounded size, which gives each shard the value
   stored before it;
3. every shard is gated from that value, independently.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import gate
from tidemark.operators.joins import lookup_join
from tidemark.operators.shards import TARGET_ROWS, hot_keys, with_previous, with_running_count, with_shard
from tidemark.session import cut_lineage

# Tasks get the functions of this module by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHAIN = 512  # shard summaries chained by one task, fewer if they are long
PROBES_PER_TASK = 2_000_000
_PROBES = "array<struct<probe:double,final:double>>"


def effective_deadbands(tags: DataFrame, default: float) -> DataFrame:
    """The tags that carry a positive deadband."""
    band = values.effective_deadband(F.col("deadband_override"), default)
    return tags.select("tag_id", band.alias("band")).filter(F.col("band").isNotNull())


def deadbanded_tags(tags: DataFrame, default: float) -> DataFrame:
    return effective_deadbands(tags, default).agg(F.count("*").alias("deadbanded"))


def is_gated(exempt: Column | None = None) -> Column:
    """Numeric, Good readings of a tag with a deadband; everything else passes untouched."""
    good = F.col("quality").eqNullSafe(F.lit(values.GOOD_CODE))
    gated = F.col("value").isNotNull() & good & F.col("band").isNotNull()
    return gated if exempt is None else gated & ~F.coalesce(exempt, F.lit(False))


def deadband(
    readings: DataFrame,
    tags: DataFrame,
    default: float = 0.0,
    exempt: Column | None = None,
    baseline: DataFrame | None = None,
    target: int = TARGET_ROWS,
) -> DataFrame:
    """The readings that are stored.

    ``exempt`` marks readings that always pass (booleans, for sites that never want a transition
    dropped). ``baseline`` (tag_id, last_stored) continues an earlier run, so a history can be
    thinned day by day. Tags with more than ``target`` rows are hot.
    """
    columns = readings.columns
    banded = lookup_join(readings, effective_deadbands(tags, default), ["tag_id"], "left", salt_on="id")
    banded = cut_lineage(banded.withColumn("gated", is_gated(exempt)))  # read several times below
    passing = banded.filter(~F.col("gated")).select(*columns)
    gated = banded.filter("gated").drop("gated")
    hot = hot_keys(gated.select("tag_id", "id"), "tag_id", "id", target)
    sharded = with_shard(gated, "tag_id", "id", hot)
    if baseline is not None:
        baseline = baseline.select("tag_id", "last_stored").filter(F.col("last_stored").isNotNull())
    entries = None
    if hot is not None:
        hot_rows = sharded.select("tag_id", "shard", "id", "value", "band")
        hot_rows = lookup_join(hot_rows, hot.select("tag_id").distinct(), ["tag_id"], "left_semi", salt_on="id")
        entries = shard_entries(shard_transfers(hot_rows), baseline)
    if baseline is not None:
        cold = baseline if hot is None else baseline.join(hot.select("tag_id").distinct(), "tag_id", "left_anti")
        cold = cold.select("tag_id", F.lit(0).cast("long").alias("shard"), F.col("last_stored").alias("entry"))
        entries = cold if entries is None else entries.unionByName(cold)
    if entries is None:
        started = sharded.withColumn("entry", F.lit(None).cast("double")).withColumn("known", F.lit(None).cast("boolean"))
    else:
        started = lookup_join(sharded, entries.withColumn("known", F.lit(True)), ["tag_id", "shard"], "left")
    kept = (
        started.repartition("tag_id", "shard").sortWithinPartitions("tag_id", "shard", "id")
        .mapInArrow(_gate_sorted, started.schema)
    )
    return passing.unionByName(kept.select(*columns))


def _gate_sorted(batches):
    carried = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [_array(batch, name) for name in ("tag_id", "shard", "value", "band", "entry")]
        known = ~_nulls(batch, "known")
        keep, carried = gate.gate_batch(*columns, known, carried)
        yield batch.filter(pa.array(keep))


def _array(batch, name):
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _nulls(batch, name):
    return np.asarray(batch.column(batch.schema.get_field_index(name)).is_null())


def shard_transfers(rows: DataFrame) -> DataFrame:
    """One row per (tag, shard): its band and what it does to an unknown last stored value."""

    def summarise(key, pdf):
        pdf = pdf.sort_values("id")
        band = float(pdf["band"].iloc[0])
        probes = gate.transfer(pdf["value"].to_numpy(), band)
        row = [{"probe": probe, "final": final} for probe, final in probes]
        return _frame(tag_id=[key[0]], shard=[key[1]], band=[band], probes=[row])

    schema = f"tag_id {_type(rows, 'tag_id')}, shard long, band double, probes {_PROBES}"
    return cut_lineage(rows.groupBy("tag_id", "shard").applyInPandas(summarise, schema))


def shard_entries(transfers: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(tag_id, shard, entry): the value stored before each shard.

    A tag with more than ``CHAIN`` shards is chained in two or more levels, each group holding at
    most that many consecutive summaries, or fewer where values that creep in tiny steps make the
    summaries long. A shard that starts with nothing stored has no row.
    """
    tag_type = _type(transfers, "tag_id")
    out = f"tag_id {tag_type}, shard long, entry double"
    last_shard, longest = transfers.agg(F.max("shard"), F.max(F.size("probes"))).first()
    chain = max(2, min(CHAIN, PROBES_PER_TASK // max(1, longest or 0)))
    groups = (last_shard or 0) // chain
    grouped = transfers.withColumn("_group", F.floor(F.col("shard") / chain))
    group_entries = None
    if groups == 0 and baseline is not None:
        group_entries = baseline.select(
            "tag_id", F.lit(0).cast("long").alias("_group"), F.col("last_stored").alias("entry")
        )
    elif groups > 0:

        def merge(key, pdf):
            pdf = pdf.sort_values("shard")
            band = float(pdf["band"].iloc[0])
            probes = gate.compose([_pairs(row) for row in pdf["probes"]], band)
            row = [{"probe": probe, "final": final} for probe, final in probes]
            return _frame(tag_id=[key[0]], shard=[key[1]], band=[band], probes=[row])

        merged = cut_lineage(
            grouped.groupBy("tag_id", "_group").applyInPandas(
                merge, f"tag_id {tag_type}, shard long, band double, probes {_PROBES}"
            )
        )
        group_entries = shard_entries(merged, baseline).withColumnRenamed("shard", "_group")

    def walk(key, pdf):
        pdf = pdf.sort_values("shard")
        band = float(pdf["band"].iloc[0])
        last = float(pdf["entry"].iloc[0]) if bool(pdf["known"].iloc[0]) else None
        shards, entries = [], []
        for shard, row in zip(pdf["shard"], pdf["probes"]):
            probes = _pairs(row)
            if last is not None:
                shards.append(shard)
                entries.append(last)
                last = gate.apply_transfer(probes, band, last)
            elif probes:
                last = probes[0][1]  # with nothing stored the first value always is
        return _frame(tag_id=[key[0]] * len(shards), shard=shards, entry=entries)

    if group_entries is None:
        entered = grouped.withColumn("entry", F.lit(None).cast("double")).withColumn("known", F.lit(False))
    else:
        entered = lookup_join(grouped, group_entries.withColumn("known", F.lit(True)), ["tag_id", "_group"], "left")
        entered = entered.withColumn("known", F.coalesce("known", F.lit(False)))
    return cut_lineage(entered.groupBy("tag_id", "_group").applyInPandas(walk, out))


def _pairs(row):
    """The (probe, final) pairs of one summary; pandas hands NaN back as a missing value."""
    return [tuple(float("nan") if x is None else x for x in (step["probe"], step["final"])) for step in row]


def _frame(**columns):
    import pandas as pd

    return pd.DataFrame(columns)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def last_stored(kept: DataFrame, tags: DataFrame, default: float = 0.0, exempt: Column | None = None) -> DataFrame:
    """The reference value each tag ends with: the ``baseline`` of the next run."""
    banded = lookup_join(kept, effective_deadbands(tags, default), ["tag_id"], "left", salt_on="id")
    return banded.filter(is_gated(exempt)).groupBy("tag_id").agg(F.max_by("value", "id").alias("last_stored"))


def segments(readings: DataFrame, tags: DataFrame, default: float = 0.0, target: int = TARGET_ROWS) -> DataFrame:
    """Gated readings with the preceding value and a segment number.

    A jump of two bands or more from the preceding value is stored whatever was stored before, so
    such rows (and a tag's first row) start a segment that does not depend on earlier ones.
    """
    banded = lookup_join(readings, effective_deadbands(tags, default), ["tag_id"], "inner", salt_on="id")
    gated = banded.filter(is_gated()).select("id", "tag_id", "value", "band")
    previous = with_previous(gated, "tag_id", "id", ["value"], target).withColumn("prev_value", F.col("prev.value"))
    jump = F.abs(F.col("value") - F.col("prev_value")) < 2 * F.col("band") * (1 + 1e-12)
    # a NaN next to a number is never within the band
    near = F.when(F.isnan("value") | F.isnan("prev_value"), F.lit(False)).otherwise(jump)
    anchor = ~F.coalesce(near, F.lit(False))
    marked = previous.withColumn("anchor", anchor)
    counted = with_running_count(marked, "tag_id", "id", F.col("anchor"), "segment", target)
    return counted.select("id", "tag_id", "value", "prev_value", "anchor", "segment")
