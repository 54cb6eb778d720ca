"""Arrow batches of texts through numpy: byte positions of words, hashes of spans, sums by row."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 2 * 1024 * 1024
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D  # odd, so that its powers have inverses modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def map_texts(df: DataFrame, column: str, function: Callable[[pa.StringArray], list], fields: list[T.StructField], batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df`` with the text ``column`` replaced by ``fields``; all other columns pass through untouched.

    ``function`` takes a null-free text array of about ``batch_bytes`` and returns one value list per field.
    """
    others = [f for f in df.schema.fields if f.name != column]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in others] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _split(batch, column, batch_bytes):
                texts = part.column(column)
                if texts.null_count:
                    texts = texts.fill_null("")
                made = [v.cast(k) if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(function(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in others] + made, names=names)

    return df.mapInArrow(run, T.StructType([*others, *fields]))


def _split(batch: pa.RecordBatch, column: str, batch_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``batch_bytes`` of text, at least one row each."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > batch_bytes:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each text begins (one more entry than texts)."""
    wide = texts.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than ASCII white space."""
    solid = ~SPACES[raw]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < len(raw))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spread(i: int) -> np.uint64:
    """The i-th of a sequence of well spread 64-bit numbers."""
    return np.uint64(i * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all 64 (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(1, n), dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


class SpanHashes:
    """64-bit hashes of byte spans from one running sum: equal spans hash alike wherever they stand."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        codes = _powers(BASE, n)[:n]
        codes *= BYTE_CODES[raw]
        np.cumsum(codes, out=self.sums[1:])
        self.back = _powers(BASE_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def joined_hashes(parts: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """Order-dependent hashes of ``count`` neighbouring entries of ``parts`` that start at ``first``."""
    out = np.zeros(len(first), dtype=np.uint64)
    for i in range(count):
        out = mixed(out * np.uint64(3) + parts[first + i] + spread(i + 1))
    return out
