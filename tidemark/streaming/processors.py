"""Per-tag state for streams: the selection, the last stored value, and the last seen row.

Tags share a call in buckets, because a call per tag costs far more than the work it does. A bucket's state is a map
from tag to entry: a micro-batch reads the entries of the tags it holds and writes those that it changes, however many
tags the bucket has. The number of buckets is fixed with the checkpoint: a few per core keeps calls large. Pandas does
not tell NaN from a missing number, so NaN travels as a flag and is put back afterwards.

A tag's rows of one micro-batch arrive in one task, so the trigger size bounds what a hot tag puts
there (``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``). They are ordered by id first. Rows that
arrive in a later micro-batch than a row with a higher id are handled in order of arrival.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.functions.values import GOOD_CODE, effective_deadband
from tidemark.operators import gate
from tidemark.operators.deadband import effective_deadbands, is_gated
from tidemark.operators.joins import lookup_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 128
READING = ["id", "tag_id", "ts_utc", "ts_received_utc", "value", "value_text", "quality"]

# Fixed value: the state store that Python processors require.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows) -> pd.DataFrame:
    """A bucket's rows of a micro-batch, by tag and id."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["tag_id", "id"], ignore_index=True)


def _runs(tags: np.ndarray):
    """(tag, start, stop) of each tag's rows in sorted order."""
    starts = np.flatnonzero(np.r_[True, tags[1:] != tags[:-1]]) if len(tags) else np.array([], dtype=int)
    return zip(tags[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(tags)])


def _number(value: float | None) -> float:
    """A stored value: only numbers are stored, so a missing one is NaN."""
    return float("nan") if value is None else value


def _differs(before: float | None, after: float | None) -> bool:
    return after is not None and not (before == after)


class DeadbandProcessor(StatefulProcessor):
    """Keeps the last stored value of each tag; rows outside the gate pass and leave it alone."""

    def init(self, handle):
        self.last = handle.getMapState("stored_by_tag", "tag_id long", "value double")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _in_order(rows)
        gated = pdf["gated"].to_numpy(dtype=bool)
        keep = np.ones(len(pdf), dtype=bool)
        if gated.any():
            values, bands = pdf["value"].to_numpy()[gated], pdf["band"].to_numpy()[gated]
            kept = np.ones(len(values), dtype=bool)
            for tag, start, stop in _runs(pdf["tag_id"].to_numpy()[gated]):
                entry = self.last.getValue((tag,))
                before = None if entry is None else _number(entry[0])
                kept[start:stop], after = gate.gate(values[start:stop], float(bands[start]), before)
                if _differs(before, after):
                    self.last.updateValue((tag,), (float(after),))
            keep[gated] = kept
        yield pdf.loc[keep].drop(columns=["gated", "band", "bucket"])

    def close(self):
        pass


class ChangeProcessor(StatefulProcessor):
    """Keeps the last row of each tag and passes rows that differ from it."""

    def init(self, handle):
        self.last = handle.getMapState("row_by_tag", "tag_id long", "value double, is_nan boolean, value_text string, quality int")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _in_order(rows)
        tags, value, nan = pdf["tag_id"].to_numpy(), pdf["value"].to_numpy(dtype=float), pdf["is_nan"].to_numpy(dtype=bool)
        text, quality = pdf["value_text"].astype(object).where(pdf["value_text"].notna(), None).to_numpy(), pdf["quality"].to_numpy()
        begins = np.r_[True, tags[1:] != tags[:-1]]
        same = np.zeros(len(pdf), dtype=bool)
        equal = (value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1]))  # missing, or not a number
        same[1:] = ~begins[1:] & equal & (nan[1:] == nan[:-1]) & (text[1:] == text[:-1]) & (quality[1:] == quality[:-1])

        def row(i):
            return (None if np.isnan(value[i]) else float(value[i]), bool(nan[i]), text[i], int(quality[i]))

        starts = np.flatnonzero(begins)
        for start, stop in zip(starts, [*starts[1:], len(pdf)], strict=True):
            tag = (int(tags[start]),)
            before, last = self.last.getValue(tag), row(stop - 1)
            same[start] = before is not None and row(start) == tuple(before)  # only a tag's first row meets its state
            if before is None or tuple(before) != last:
                self.last.updateValue(tag, last)
        yield pdf.loc[~same].drop(columns=["bucket"])

    def close(self):
        pass


class SelectionProcessor(StatefulProcessor):
    """Keeps what is known of each node: its tag, whether it is selected, its deadband, and the last stored value.

    Rows are notifications, or changes of the selection. Changes of a micro-batch apply before its notifications, and a
    change older than what is known is passed over. Notifications of unknown or deselected nodes drop out, the others
    go through the deadband. Deselecting a tag leaves its last stored value for the time when it is selected again.
    """

    def init(self, handle):
        entry = "tag_id int, live boolean, band double, version long, value double, stored boolean"
        self.nodes = handle.getMapState("nodes", "plc_name string, node_id string", entry)

    def handleInitialState(self, key, initialState, timerValues):
        self.change(initialState)

    def change(self, changes: pd.DataFrame) -> None:
        for row in changes.sort_values("version").itertuples(index=False):
            node = (row.plc_name, row.node_id)
            before = self.nodes.getValue(node)
            if before is None or before[3] < row.version:
                band = None if row.band is None or np.isnan(row.band) else float(row.band)
                value, stored = (None, False) if before is None else (before[4], before[5])
                self.nodes.updateValue(node, (int(row.tag_id), bool(row.live), band, int(row.version), value, stored))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        changed = pdf["changed"].to_numpy(dtype=bool)
        if changed.any():
            self.change(pdf.loc[changed])
        pdf = pdf.loc[~changed].sort_values(["plc_name", "node_id", "id"], ignore_index=True)
        if not len(pdf):
            return
        plc, node, values = pdf["plc_name"].to_numpy(), pdf["node_id"].to_numpy(), pdf["value"].to_numpy(dtype=float)
        countable, tags, keep = pdf["countable"].to_numpy(dtype=bool), np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf), dtype=bool)
        starts = np.flatnonzero(np.r_[True, (plc[1:] != plc[:-1]) | (node[1:] != node[:-1])])
        for start, stop in zip(starts, [*starts[1:], len(pdf)], strict=True):
            name = (plc[start], node[start])
            entry = self.nodes.getValue(name)
            if entry is None or not entry[1]:
                continue
            tag, live, band, version, value, stored = entry
            tags[start:stop], keep[start:stop] = tag, True
            gated = start + np.flatnonzero(countable[start:stop])
            if band is not None and len(gated):
                before = _number(value) if stored else None
                keep[gated], after = gate.gate(values[gated], band, before)
                if _differs(before, after):
                    self.nodes.updateValue(name, (tag, live, band, version, float(after), True))
        kept = pdf.assign(tag_id=tags).loc[keep]
        yield kept[[*READING, "data_type", "is_nan"]]

    def close(self):
        pass


def _per_bucket(
    flagged: DataFrame, processor: StatefulProcessor, schema: T.StructType, buckets: int, keys: list[str], known: DataFrame | None = None,
) -> DataFrame:
    """Run a processor per bucket of keys, from what is known before the first row on, and give NaN values back."""
    flagged.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")
    marked = flagged.select("*", F.coalesce(F.isnan("value"), F.lit(False)).alias("is_nan"), bucket)
    out = marked.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType([*schema.fields, T.StructField("is_nan", T.BooleanType())]),
        outputMode="append", timeMode="None", initialState=None if known is None else known.select("*", bucket).groupBy("bucket"),
    )
    value = F.when(F.col("is_nan"), F.lit(float("nan"))).otherwise(F.col("value"))
    return out.withColumn("value", value).drop("is_nan")


def deadband_stream(
    readings: DataFrame, tags: DataFrame, default: float = 0.0, exempt_boolean: bool = False, buckets: int = BUCKETS
) -> DataFrame:
    """The deadband over a stream of readings; state survives restarts with the checkpoint."""
    exempt = (F.col("data_type") == "Boolean") if exempt_boolean else None
    banded = lookup_join(readings, effective_deadbands(tags, default), ["tag_id"], "left", salt_on="id")
    gated = banded.withColumn("gated", F.coalesce(is_gated(exempt), F.lit(False)))
    return _per_bucket(gated, DeadbandProcessor(), readings.schema, buckets, ["tag_id"])


def change_stream(readings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Change-only rows of a stream of readings."""
    return _per_bucket(readings, ChangeProcessor(), readings.schema, buckets, ["tag_id"])


def selected_stream(
    notifications: DataFrame, known: DataFrame, changes: DataFrame | None = None, default: float = 0.0,
    exempt_boolean: bool = False, buckets: int = BUCKETS,
) -> DataFrame:
    """Normalised notifications of selected tags through the deadband, as readings with their data type.

    ``known`` is the selection before the first row, used once, when the checkpoint is new. ``changes`` is a stream of
    later selections; one takes effect with the micro-batch that brings it. Both have the columns of
    ``schemas.SELECTION``; of two changes of a node the one with the higher version holds.
    """
    good = F.col("quality").eqNullSafe(F.lit(GOOD_CODE)) & F.col("value").isNotNull()
    if exempt_boolean:
        good = good & ~F.coalesce(F.col("data_type") == "Boolean", F.lit(False))
    banded = lambda df: df.select(
        "plc_name", "node_id", "tag_id", "live", "version", effective_deadband(F.col("deadband_override"), default).alias("band")
    )
    # numbers are never missing, so that pandas keeps them as they are
    nothing = {"tag_id": F.lit(0), "live": F.lit(False), "version": F.lit(0).cast("long"), "band": F.lit(None).cast("double")}
    rows = notifications.withColumns({**nothing, "countable": good, "changed": F.lit(False)})
    if changes is not None:
        empty = {f.name: F.lit(None if isinstance(f.dataType, (T.StringType, T.DoubleType)) else 0).cast(f.dataType)
                 for f in notifications.schema.fields if f.name not in ("plc_name", "node_id")}
        rows = rows.unionByName(banded(changes).withColumns({**empty, "countable": F.lit(False), "changed": F.lit(True)}))
    schema = T.StructType([
        *[T.StructField("tag_id", T.IntegerType()) if name == "tag_id" else notifications.schema[name] for name in READING],
        notifications.schema["data_type"],
    ])
    return _per_bucket(rows, SelectionProcessor(), schema, buckets, ["plc_name", "node_id"], banded(known))
