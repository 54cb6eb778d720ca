"""Batch deadband: exact for any shard size, hot tags, odd numbers and resumed runs."""

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_gate import loop

from tidemark import schemas
from tidemark.operators import deadband


def history(spark, readings):
    """readings: (id, tag_id, value, quality)"""
    data = [(i, tag, 1000 * i, None, value, None, quality) for i, tag, value, quality in readings]
    return spark.createDataFrame(data, schemas.READINGS)


def tag_table(spark, overrides):
    data = [(tag, 1, f"n{tag}", f"t{tag}", "Double", None, band, "", "", 1, 1) for tag, band in overrides.items()]
    return spark.createDataFrame(data, schemas.TAGS)


def expected_ids(readings, overrides, default):
    kept, last = [], {}
    for i, tag, value, quality in sorted(readings):
        band = overrides.get(tag) if overrides.get(tag) is not None else default
        if value is None or quality != 0 or not band > 0:
            kept.append(i)
            continue
        if not (tag in last and abs(value - last[tag]) < band):
            kept.append(i)
            last[tag] = value
    return sorted(kept)


@pytest.fixture(scope="module")
def mixed():
    """A tag with two thirds of all rows that drifts slowly, noisy tags, odd numbers, bypassing rows."""
    rng = np.random.default_rng(7)
    out, level = [], 0.0
    for i in range(1, 3001):
        if rng.random() < 0.66:
            level += rng.normal(0.02, 0.3)
            out.append((i, 1, float(level), 0 if rng.random() < 0.95 else 2))
        else:
            tag = int(rng.integers(2, 6))
            value = rng.choice([rng.normal(0, 8), float("nan"), float("inf"), None], p=[0.9, 0.04, 0.03, 0.03])
            out.append((i, tag, None if value is None else float(value), int(rng.choice([0, 0, 0, 1]))))
    return out


OVERRIDES = {1: None, 2: 3.0, 3: 0.0, 4: 12.0, 5: -1.0}


@pytest.mark.parametrize("target", [10**6, 400, 25])
def test_any_shard_size_gives_the_sequential_result(spark, mixed, target):
    kept = deadband.deadband(history(spark, mixed), tag_table(spark, OVERRIDES), 4.0, target=target)
    assert sorted(r[0] for r in kept.select("id").collect()) == expected_ids(mixed, OVERRIDES, 4.0)


@pytest.mark.parametrize(("setting", "value"), [("CHAIN", 3), ("PROBES_PER_TASK", 40)])
@pytest.mark.parametrize("shape", ["noise", "creep"])
def test_chaining_in_levels(spark, mixed, monkeypatch, setting, value, shape):
    monkeypatch.setattr(deadband, setting, value)
    if shape == "noise":
        series = {i: v for i, tag, v, quality in mixed if tag == 1 and quality == 0}
    else:
        series = {i: i * 0.05 for i in range(1200)}  # every value is a new maximum
    frame = spark.createDataFrame([(i, 1, i // 40, v, 4.0) for i, v in series.items()], "id long, tag_id int, shard long, value double, band double")
    transfers = deadband.shard_transfers(frame)
    entries = {r["shard"]: r["entry"] for r in deadband.shard_entries(transfers, None).collect()}
    last, want = None, {}
    for shard in sorted({i // 40 for i in series}):
        if last is not None:
            want[shard] = last
        last = loop([v for i, v in series.items() if i // 40 == shard], 4.0, last)[1]
    assert entries == want


def test_resumed_run_equals_one_run(spark, mixed):
    tags = tag_table(spark, OVERRIDES)
    first = [r for r in mixed if r[0] <= 1700]
    second = [r for r in mixed if r[0] > 1700]
    kept = deadband.deadband(history(spark, first), tags, 4.0, target=200)
    baseline = deadband.last_stored(kept, tags, 4.0)
    more = deadband.deadband(history(spark, second), tags, 4.0, baseline=baseline, target=200)
    got = sorted(r[0] for r in kept.unionByName(more).select("id").collect())
    assert got == expected_ids(mixed, OVERRIDES, 4.0)


def test_stored_neighbours_differ_by_the_band(spark, mixed):
    kept = deadband.deadband(history(spark, mixed), tag_table(spark, OVERRIDES), 4.0)
    values = [r["value"] for r in kept.filter((F.col("tag_id") == 1) & (F.col("quality") == 0)).orderBy("id").collect()]
    assert all(abs(b - a) >= 4.0 for a, b in zip(values, values[1:]))


def test_a_bad_spike_passes_and_leaves_the_baseline(spark):
    readings = [(1, 1, 10.0, 0), (2, 1, 99.0, 2), (3, 1, 11.0, 0), (4, 1, 15.0, 0)]
    kept = deadband.deadband(history(spark, readings), tag_table(spark, {1: 5.0}))
    assert rows(kept, "id") == [(1,), (2,), (4,)]


def test_zero_override_beats_a_positive_default(spark):
    readings = [(1, 1, 1.0, 0), (2, 1, 1.0, 0), (3, 2, 1.0, 0), (4, 2, 1.0, 0)]
    kept = deadband.deadband(history(spark, readings), tag_table(spark, {1: 0.0, 2: None}), 5.0)
    assert rows(kept, "id") == [(1,), (2,), (3,)]


def test_booleans_are_gated_unless_exempt(spark):
    readings = [(1, 1, 0.0, 0), (2, 1, 1.0, 0), (3, 1, 0.0, 0)]
    frame = history(spark, readings).withColumn("data_type", F.lit("Boolean"))
    tags = tag_table(spark, {1: 2.0})
    assert rows(deadband.deadband(frame, tags), "id") == [(1,)]
    assert rows(deadband.deadband(frame, tags, exempt=F.col("data_type") == "Boolean"), "id") == [(1,), (2,), (3,)]


def test_empty_history(spark):
    assert rows(deadband.deadband(history(spark, []), tag_table(spark, {1: 2.0}))) == []


def test_segments_do_not_depend_on_shards(spark, mixed):
    readings, tags = history(spark, mixed), tag_table(spark, OVERRIDES)
    assert rows(deadband.segments(readings, tags, 4.0)) == rows(deadband.segments(readings, tags, 4.0, target=50))
