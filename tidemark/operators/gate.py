"""The deadband rule on arrays: small helpers that run inside Spark tasks.

A value is stored unless it lies strictly within the band of the last stored value; the stored
value becomes the new reference. Comparisons with NaN are false, so NaN is stored and so is the
value after it.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Tasks get these helpers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256
STEPS = 64


def gate(values: np.ndarray, band: float, last: float | None) -> tuple[np.ndarray, float | None]:
    """Which of ``values`` (in order) are stored, and the last stored value afterwards.

    Short gaps between stored values are stepped through; longer ones are crossed block by block.
    """
    n = len(values)
    keep = np.zeros(n, dtype=bool)
    if n and last is None:
        keep[0], last = True, float(values[0])
        i = 1
    else:
        i = 0
    listed = values.tolist()
    while i < n:
        stop = min(i + STEPS, n)
        while i < stop and abs(listed[i] - last) < band:
            i += 1
        while i == stop and i < n:
            stop = min(i + BLOCK * 16, n)
            with np.errstate(invalid="ignore"):
                out = ~(np.abs(values[i:stop] - last) < band)
            first = int(out.argmax())
            i = i + first if out[first] else stop
        if i < n:
            keep[i], last = True, listed[i]
            i += 1
    return keep, last


def gate_batch(tags, shards, values, bands, entries, known, carried):
    """Gate one batch of rows sorted by (tag, shard) and order.

    ``carried`` is (tag, shard, last stored value) from the batch before. The first row of a shard
    starts from ``entries`` where ``known`` is set, else with nothing stored.
    """
    keep = np.ones(len(values), dtype=bool)
    changes = (tags[1:] != tags[:-1]) | (shards[1:] != shards[:-1])
    starts = np.flatnonzero(np.r_[True, changes]).tolist()
    for start, stop in zip(starts, [*starts[1:], len(values)]):
        at = (int(tags[start]), int(shards[start]))
        if carried is not None and carried[0] == at:
            last = carried[1]
        else:
            last = float(entries[start]) if known[start] else None
        keep[start:stop], last = gate(values[start:stop], float(bands[start]), last)
        carried = (at, last)
    return keep, carried


def transfer(values: np.ndarray, band: float) -> list[tuple[float, float]]:
    """What a run of values does to an unknown last stored value, as a list of (probe, exit).

    For a last stored value ``s`` the first probe with ``not abs(probe - s) < band`` names the value
    stored after the run; if there is none, ``s`` itself still is. Only values that set a new
    minimum or maximum can be the first to leave the band of ``s``, and once two of them are two
    bands apart no ``s`` is within both, so the list stays short unless values drift in tiny steps.
    """
    probes, low, high = [], np.inf, -np.inf
    for i, value in enumerate(values.tolist()):
        if not np.isfinite(value):
            probes.append(i)
            break
        if value > high or value < low:
            probes.append(i)
            low, high = min(low, value), max(high, value)
            if high - low >= 2 * band * (1 + 1e-9):
                break
    follow = _Next(values, band)
    exits: dict[int, float] = {}
    for i in reversed(probes):
        walked, at = [], i
        while at is not None and at not in exits:
            walked.append(at)
            at = follow(at)
        final = exits[at] if at is not None else float(values[walked[-1]])
        exits.update((step, final) for step in walked)
    return [(float(values[i]), exits[i]) for i in probes]


def apply_transfer(probes, band: float, last: float) -> float:
    for probe, final in probes:
        if not abs(probe - last) < band:
            return final
    return last


def compose(runs, band: float) -> list[tuple[float, float]]:
    """The transfer of consecutive runs taken as one."""
    whole: list[tuple[float, float]] = []
    low, high, closed = np.inf, -np.inf, False
    for probes in runs:
        whole = [(probe, apply_transfer(probes, band, final)) for probe, final in whole]
        for probe, final in probes:
            if closed:
                break
            if not np.isfinite(probe):
                whole.append((probe, final))
                closed = True
            elif probe > high or probe < low:
                whole.append((probe, final))
                low, high = min(low, probe), max(high, probe)
                closed = high - low >= 2 * band * (1 + 1e-9)
    return whole


class _Next:
    """The next row after ``i`` that is stored when row ``i`` is, found block by block."""

    def __init__(self, values: np.ndarray, band: float):
        self.values, self.band = values, band
        blocks = -(-len(values) // BLOCK)
        padded = np.full(blocks * BLOCK, values[-1] if len(values) else 0.0)
        padded[: len(values)] = values
        grid = padded.reshape(blocks, BLOCK)
        odd = ~np.isfinite(grid).all(axis=1)
        self.low = np.where(odd, -np.inf, grid.min(axis=1))
        self.high = np.where(odd, np.inf, grid.max(axis=1))

    def __call__(self, i: int) -> int | None:
        value, n = self.values[i], len(self.values)
        slack = self.band * (1 - 1e-9)
        block = i // BLOCK
        found = self._inside(i + 1, min((block + 1) * BLOCK, n), value)
        while found is None:
            block += 1
            if block >= len(self.low):
                return None
            if np.isfinite(value):
                ahead = (self.high[block:] - value >= slack) | (value - self.low[block:] >= slack)
                step = int(ahead.argmax())
                if not ahead[step]:
                    return None
                block += step
            found = self._inside(block * BLOCK, min((block + 1) * BLOCK, n), value)
        return found

    def _inside(self, start: int, stop: int, value: float) -> int | None:
        if start >= stop:
            return None
        with np.errstate(invalid="ignore"):
            out = ~(np.abs(self.values[start:stop] - value) < self.band)
        first = int(out.argmax())
        return start + first if out[first] else None
