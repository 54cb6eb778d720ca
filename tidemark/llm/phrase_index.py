"""A full-text index of word ids in two directions, and what its rows are made of and packed in."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def packed(values: np.ndarray) -> bytes:
    """An integer array in the fewest bytes per number that hold it, compressed."""
    values = np.ascontiguousarray(values)
    small = values.astype(np.int32) if values.dtype == np.int64 and len(values) and 0 <= values.min() and values.max() < 2**31 else values
    size = small.dtype.itemsize
    planes = small.view(np.uint8).reshape(-1, size).T.tobytes() if len(small) else b""  # high bytes apart: they are nearly all alike
    return np.array([size, len(small)], np.int64).tobytes() + (pa.Codec("zstd").compress(planes, asbytes=True) if planes else b"")


def unpacked(data: bytes) -> np.ndarray:
    """What was packed, as 64-bit integers."""
    size, n = np.frombuffer(data[:16], np.int64)
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[16:], decompressed_size=int(size * n)), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(np.int32 if size == 4 else np.int64).ravel().astype(np.int64)


def packed_text(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.Codec("zstd").compress(text, asbytes=True)


def unpacked_text(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


class Index:
    """The Burrows-Wheeler transform of a text of word ids, with positions in order of the ``depth`` words that follow.

    The text begins and ends with 0, which separates pieces and is smaller than any word. Rows whose next ``depth`` words
    are equal stand in any order, so the rows of a phrase of up to ``depth`` words are one interval.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, rank, done = len(text), text.astype(np.int64), 1
        order = np.argsort(rank) if depth == 1 else None
        while done < depth:
            step = min(done, depth - done)
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            done += step
        self.n, self.positions, self.before = n, order, text[order - 1].astype(np.int64)
        self.keys = np.sort(self.before * n + np.arange(n))  # the rows before which each word stands, word by word

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each phrase (a line of word ids), by backward steps from its last word."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for words in phrases.T[::-1]:
            low, high = np.searchsorted(self.keys, words * self.n + low), np.searchsorted(self.keys, words * self.n + high)
        return low, high

    def rest(self, rows: np.ndarray) -> np.ndarray:
        """For each row one whose text begins a word later."""
        return self.keys[rows] % self.n


def ranges(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges, and the range each belongs to."""
    of = np.repeat(np.arange(len(low)), size)
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(of)), of


def extensions(text: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word before one of ``phrases`` with the phrase's line and the count, and the text without what no phrase covers.

    Two indexes, of the text and of the text read backwards, hold a phrase's interval in step: the words before it stand in
    the transform's interval, and how many of them are smaller tells where the longer phrase begins in the other index. Of the
    longer phrases those come whose first words are among ``phrases`` too. Single words stand for all words of the text.
    """
    length = phrases.shape[1]
    there = Index(text, length)
    low, high = there.find(phrases)
    size = high - low
    rows, of = ranges(low, size)
    wide = int(text.max(initial=0)) + 1
    key = np.sort(of * wide + there.before[rows])
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[begins, len(key)])
    line, word = key[begins] // wide, key[begins] % wide
    if length > 1:
        back = Index(text[::-1], length + 1)
        back_low, back_high = back.find(phrases[:, ::-1])
        known = np.zeros(back.n + 1, np.int64)
        np.add.at(known, back_low, 1)
        np.add.at(known, back_high, -1)
        smaller = begins - (np.cumsum(size) - size)[line]
        good = (np.cumsum(known)[back.rest(back_low[line] + smaller)] > 0) & (word > 0)
        starts = there.positions[rows]
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + length, -1)
        text = np.where(np.cumsum(cover)[:-1] > 0, text, 0)
    else:
        good = word > 0
    return word[good], line[good], counts[good], thinned(text)


def thinned(text: np.ndarray) -> np.ndarray:
    """The text with one separator in place of several, and one at either end."""
    text = np.r_[0, text, 0]
    return text[np.r_[True, (text[1:] > 0) | (text[:-1] > 0)]]
