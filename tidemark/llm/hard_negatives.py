"""Hard negatives: pairs in (anchor, falling score, id) order, and an iterator that opens a window per positive."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import topk_search
from tidemark.llm.topk_search import _products, quantised
from tidemark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(topk_search)

RESIDENT = 4096  # anchors a task holds
SLICE = 512  # anchors multiplied at a time
BLOCK_ROWS = 4096  # rows that stream past them at a time
BLOCKS_PER_TASK = 256
LONGEST = float(2**62)  # of a squared vector; with less, no score leaves 64 bits
NONE = -(2**63) + 1
BLOCK = "dim int, n int, rows binary, ids binary, labels binary, data binary, low binary, high binary"
PAIR = "row long, anchor_id long, score long, id long, pair long"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _usable(vectors: DataFrame, anchors: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row, id, label, v, anchor of all rows that take part, as a written table."""
    whole = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return cut_lineage(whole.filter(square < LONGEST).withColumn("row", F.monotonically_increasing_id()))


def _pack(batches: Iterator[pa.RecordBatch], size: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` vectors of one length, by id, with the windows of their positives if they have any."""
    for batch in batches:
        lists, names = batch.column("v"), batch.schema.names
        at = lists.offsets.to_numpy().astype(np.int64)
        values, dims = lists.values.to_numpy(), np.diff(at)
        column = lambda name: batch.column(name).to_numpy()  # noqa: B023, E731
        rows, ids, labels = column("row"), column("id"), column("label")
        scores = batch.column("scores").to_pylist() if "scores" in names else None
        out = []
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            mine = mine[np.argsort(labels[mine], kind="stable")]
            for start in range(0, len(mine), size):
                block = mine[start : start + size]
                block = block[np.lexsort((rows[block], ids[block]))]
                matrix = values[at[block][:, None] + np.arange(dim)].astype(np.int64)
                windows = [b"", b""]
                if scores is not None:
                    wide = max((len(scores[i]) for i in block), default=0)
                    windows = [np.array([[edge(s) for s in scores[i]] + [empty] * (wide - len(scores[i])) for i in block], np.int64).tobytes()
                               for edge, empty in ((lambda s: -(-low * s // 100), 1), (lambda s: high * s // 100, 0))]
                small = np.abs(matrix).max(initial=0) < 2**15
                out.append([int(dim), len(block), rows[block].tobytes(), ids[block].tobytes(), labels[block].tobytes(),
                            matrix.astype(np.int16 if small else np.int64).tobytes(), *windows])
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))],
                names=["dim", "n", "rows", "ids", "labels", "data", "low", "high"],
            )


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        narrow = n * dim > 0 and len(row["data"]) == 2 * n * dim
        self.dim, self.n = dim, n
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.data = np.frombuffer(row["data"], np.int16 if narrow else np.int64).reshape(n, dim).astype(np.int64)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(n, -1) if row[c] else None for c in ("low", "high"))


class Best:
    """For each anchor of a block and each of its windows, the ``k`` best pairs seen: higher scores first, then smaller ids."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        windows = 1 if block.low is None else block.low.shape[1]
        self.scores = np.full((block.n, windows, k), NONE, np.int64)
        self.ids = np.zeros_like(self.scores)
        self.rows = np.zeros_like(self.scores)

    def meet(self, other: Block) -> None:
        for start in range(0, self.block.n, SLICE):
            part = np.arange(start, min(start + SLICE, self.block.n))
            if self.block.low is None:  # only anchors whose label stands in the block
                part = part[np.isin(self.block.labels[part], other.labels)]
            if not len(part):
                continue
            scores = _products(self.block.data[part], other.data)
            same = self.block.labels[part][:, None] == other.labels
            if self.block.low is None:
                scores[~same | (self.block.rows[part][:, None] == other.rows)] = NONE
                self._keep(part, 0, scores, other)
                continue
            scores[same] = NONE
            for w in range(self.block.low.shape[1]):
                low, high = self.block.low[part, w, None], self.block.high[part, w, None]
                self._keep(part, w, np.where((scores >= low) & (scores <= high), scores, NONE), other)

    def _keep(self, part: np.ndarray, w: int, scores: np.ndarray, other: Block) -> None:
        """Merges the best of ``scores``, whose columns stand in the order of ids, with what was best before."""
        some = np.flatnonzero(scores.max(axis=1, initial=NONE) > np.maximum(self.scores[part, w, -1] - 1, NONE))
        if not len(some):
            return
        part, scores = part[some], scores[some]
        line = np.arange(len(part))
        found = [[self.scores[part, w], self.ids[part, w], self.rows[part, w]]]
        for _ in range(min(self.k, other.n)):
            best = scores.argmax(axis=1)
            found.append([a[:, None] for a in (scores[line, best], other.ids[best], other.rows[best])])
            scores[line, best] = NONE
        points, ids, rows = (np.concatenate(x, axis=1) for x in zip(*found, strict=True))
        order = np.lexsort((rows, ids, -points), axis=-1)[:, : self.k]
        self.scores[part, w], self.ids[part, w], self.rows[part, w] = (np.take_along_axis(x, order, 1) for x in (points, ids, rows))

    def pairs(self) -> pa.RecordBatch:
        """Every kept pair once, also if it stands in several windows."""
        anchor, window, place = np.nonzero(self.scores > NONE)
        order = np.lexsort((self.rows[anchor, window, place], anchor))
        anchor, window, place = anchor[order], window[order], place[order]
        pair = self.rows[anchor, window, place]
        once = np.ones(len(pair), bool)
        once[1:] = (anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1])
        anchor, window, place, pair = anchor[once], window[once], place[once], pair[once]
        columns = [self.block.rows[anchor], self.block.ids[anchor], self.scores[anchor, window, place], self.ids[anchor, window, place], pair]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "anchor_id", "score", "id", "pair"])


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a cell stream past its anchors, which stand before them."""
    cell, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["cell"] != cell:
                yield from (best.pairs() for best in held)
                cell, held = row["cell"], []
            block = Block(row)
            if not row["streams"]:
                held.append(Best(block, k))
            else:
                for best in held:
                    if best.block.dim == block.dim:
                        best.meet(block)
    yield from (best.pairs() for best in held)


def _tiled(anchors: DataFrame, n_anchors: int, blocks: DataFrame, n_blocks: int, k: int, windows: tuple[int, int], resident: int) -> DataFrame:
    """The best ``k`` pairs of every anchor, or of each of its windows, per cell of a grid of anchor groups and block groups.

    A group of at most about ``resident`` anchors stays in its task while the blocks of a group stream past, so anchors are
    copied once per column of the grid and blocks once per row.
    """
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-n_anchors // resident))
    across = max(1, min(n_blocks, max(-(-2 * cores // down), -(-n_blocks // BLOCKS_PER_TASK))))
    group = F.pmod(F.xxhash64("row"), F.lit(down)).cast("int")
    packs = anchors.repartitionById(down, group).mapInArrow(lambda b: _pack(b, resident, *windows), BLOCK)
    packs = cut_lineage(packs.withColumn("down", F.spark_partition_id()))
    held = packs.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("streams", F.lit(False))
    passing = blocks.withColumn("across", F.pmod(F.xxhash64("rows"), F.lit(across)).cast("int"))
    passing = passing.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("streams", F.lit(True))
    both = held.unionByName(passing.select(*held.columns)).withColumn("cell", F.col("down") * across + F.col("across"))
    dealt = both.repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "streams")
    return dealt.drop("down", "across").mapInArrow(lambda b: _cells(b, k), PAIR)


def _windows(batches: Iterator[pa.RecordBatch], negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Reads pairs by anchor, falling score and id: a positive opens its window, negatives go to every open one they fit.

    A window closes when it is full or the scores have fallen below it; nothing else is kept of an anchor.
    """
    row, windows = None, []
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if r["row"] != row:
                row, windows = r["row"], []
            score = r["score"]
            windows = [w for w in windows if w[1] <= score and w[0] < negatives]
            if not r["negative"]:
                windows.append([0, -(-low * score // 100), high * score // 100, r["id"], score])
                continue
            for w in windows:
                if score <= w[2] and w[0] < negatives:
                    w[0] += 1
                    out.append((r["anchor_id"], w[3], w[0], r["id"], w[4], score))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", resident: int = RESIDENT, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Every component x becomes floor(scale * x); a score is the integer inner product, higher ones come first, of ties the
    smaller id. An anchor's positives are its ``positives`` best other rows of the same label. For each of them come the
    ``negatives`` best rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    Positives are found first, in tiles; then tiles keep, per window of a positive, the pairs that can be among its first.
    What is left of all pairs is shuffled by anchor and sorted by falling score and id within partitions, and a streaming
    iterator emits negatives as it passes them, so no task holds an anchor's pairs, whatever their number.

    Rows without id or label, with a null vector or one that holds null or non-finite components take no part; nor do
    vectors whose squared length after scaling reaches 2^62, as their scores do not fit a long. Labels are integers. Vectors
    meet only others of their length. A repeated row is another row: it can be positive or negative as often as it stands
    there, and a repeated anchor gives repeated results. Windows of negative positives are empty. Empty tables give no rows.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("a window lies between 0 and 100 percent of the positive's score")
    rows = _usable(vectors, anchors, scale, id_col, vector_col, label_col)
    count, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    order = [F.size("v"), F.col("label"), F.col("row")]
    dealt = rows.drop("anchor").repartitionByRange(max(1, -(-count // block_rows)), *order).sortWithinPartitions(*order)
    blocks = cut_lineage(dealt.mapInArrow(lambda b: _pack(b, block_rows, low, high), BLOCK))
    n_blocks = blocks.count()
    chosen, windows = rows.filter("anchor").drop("anchor"), (low, high)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id", "pair")
    near = _tiled(chosen, n_anchors, blocks, n_blocks, positives, windows, resident)
    near = cut_lineage(near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).drop("place", "pair"))
    asked = chosen.join(near.groupBy("row").agg(F.collect_list("score").alias("scores")), "row")
    apart = _tiled(asked, n_anchors, blocks, n_blocks, negatives, windows, resident)
    pairs = near.withColumn("negative", F.lit(False)).unionByName(apart.drop("pair").withColumn("negative", F.lit(True)))
    secondary = pairs.repartition("row").sortWithinPartitions("row", F.desc("score"), "negative", "id")
    return secondary.mapInArrow(lambda b: _windows(b, negatives, low, high), FOUND)
