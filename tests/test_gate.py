"""The array form of the deadband against a plain loop."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import gate


def loop(values, band, last=None):
    keep = []
    for value in values:
        stored = last is None or not abs(value - last) < band
        keep.append(stored)
        last = value if stored else last
    return keep, last


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


numbers = st.one_of(
    st.floats(-30, 30), st.integers(-8, 8).map(float), st.sampled_from([float("nan"), float("inf"), float("-inf"), -0.0])
)
series = st.lists(numbers, max_size=60)
bands = st.sampled_from([0.5, 1.0, 3.0, 7.25, 20.0])


@given(series, bands, st.one_of(st.none(), numbers))
@settings(max_examples=300, deadline=None)
def test_gate_equals_loop(values, band, last):
    keep, end = gate.gate(np.array(values, dtype=float), band, last)
    expected, expected_end = loop(values, band, last)
    assert keep.tolist() == expected and same(end, expected_end)


@given(st.lists(series, min_size=1, max_size=6), bands, numbers)
@settings(max_examples=300, deadline=None)
def test_transfer_and_compose_give_the_exit(runs, band, last):
    transfers = [gate.transfer(np.array(run, dtype=float), band) for run in runs]
    at = last
    for run, probes in zip(runs, transfers):
        expected = loop(run, band, at)[1]
        at = gate.apply_transfer(probes, band, at)
        assert same(at, expected)
    assert same(gate.apply_transfer(gate.compose(transfers, band), band, last), at)


def test_long_gaps_are_crossed_in_blocks():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.normal(0, 0.05, 50_000))
    keep, last = gate.gate(values, 5.0, None)
    expected, expected_last = loop(values.tolist(), 5.0)
    assert keep.tolist() == expected and last == expected_last


def test_transfer_of_a_slow_drift():
    values = np.arange(0, 400, 0.01)
    probes = gate.transfer(values, 5.0)
    for last in (-4.99, -1.234, 0.0, 3.3, 4.99):
        assert gate.apply_transfer(probes, 5.0, last) == loop(values.tolist(), 5.0, last)[1]


def test_batches_carry_over_and_restart_per_shard():
    tags = np.array([1, 1, 1, 2, 2, 2])
    shards = np.array([0, 0, 1, 0, 0, 0])
    values = np.array([0.0, 1.0, 1.0, 5.0, 5.5, 9.0])
    band, entry = np.full(6, 2.0), np.array([0, 0, 0.5, 5.4, 5.4, 5.4])
    known = np.array([False, False, True, True, True, True])
    whole, _ = gate.gate_batch(tags, shards, values, band, entry, known, None)
    assert whole.tolist() == [True, False, False, False, False, True]
    for cut in range(1, 6):
        first, carried = gate.gate_batch(*(a[:cut] for a in (tags, shards, values, band, entry, known)), None)
        second, _ = gate.gate_batch(*(a[cut:] for a in (tags, shards, values, band, entry, known)), carried)
        assert first.tolist() + second.tolist() == whole.tolist()


def test_equality_with_the_band_is_stored():
    keep, _ = gate.gate(np.array([0.0, 1.999, 2.0, 3.0]), 2.0, None)
    assert keep.tolist() == [True, False, True, False]
