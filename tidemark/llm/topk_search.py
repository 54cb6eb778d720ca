"""Exact top-k search by inner product: tiles of queries and shards, merged up a tree."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN_IN = 8
PACKED = "part int, dim int, n int, keys binary, ids binary, data binary"
LISTS = "query_key long, query_id long, run long, top array<struct<loss: long, vec_id: long>>"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a long; null for vectors that hold null or non-finite ones."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))))


def _pack(parts: Iterator[pd.DataFrame], rows_per_block: int) -> Iterator[pd.DataFrame]:
    """Blocks of at most ``rows_per_block`` vectors of one part and dimension as integer matrices."""
    for batch in parts:
        batch = batch.assign(dim=batch["v"].map(len))
        for (part, dim), rows in batch.groupby(["part", "dim"]):
            for start in range(0, len(rows), rows_per_block):
                block = rows.iloc[start : start + rows_per_block]
                matrix = np.array([np.asarray(v) for v in block["v"]], dtype=np.int64).reshape(len(block), dim)
                fits = np.abs(matrix).max(initial=0) < 2**15 and matrix.min(initial=0) > -(2**62)
                yield pd.DataFrame({
                    "part": [int(part)], "dim": [int(dim)], "n": [len(block)],
                    "keys": [block["key"].to_numpy(np.int64).tobytes()], "ids": [block["id"].to_numpy(np.int64).tobytes()],
                    "data": [matrix.astype(np.int16 if fits else np.int64).tobytes()],
                })


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    narrow = n * dim > 0 and len(data) == 2 * n * dim
    return np.frombuffer(data, np.int16 if narrow else np.int64).reshape(n, dim).astype(np.int64)


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer products, by floating-point matrix code where 53 bits hold every partial sum."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, queries.shape[1])
    if largest < 2**53:
        return (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    if largest < 2**63:
        return queries @ shard.T
    exact = queries.astype(object) @ shard.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _select(tiles: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The best k candidates of every query of a tile; ties go to the smaller id."""
    for part in tiles:
        for t in part.itertuples(index=False):
            queries = _matrix(t.q_data, t.q_n, t.dim)
            shard = _matrix(t.data, t.n, t.dim)
            ids, query_ids = np.frombuffer(t.ids, np.int64), np.frombuffer(t.q_ids, np.int64)
            loss = -_products(queries, shard)
            rows = []
            for q in range(t.q_n):
                others = np.flatnonzero(ids != query_ids[q])
                mine = loss[q, others]
                if len(others) > k:
                    others = others[mine <= np.partition(mine, k - 1)[k - 1]]
                    mine = loss[q, others]
                best = others[np.lexsort((ids[others], mine))[:k]]
                rows.append([{"loss": int(loss[q, i]), "vec_id": int(ids[i])} for i in best])
            yield pd.DataFrame({"query_key": np.frombuffer(t.q_keys, np.int64), "query_id": query_ids, "run": t.run, "top": rows})


def topk_search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
    vector_col: str = "embedding", query_rows: int = 1024, shard_rows: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of every query.

    Every component x becomes floor(scale * x). Vectors are packed into shards, queries into blocks, and
    every (block, shard) tile is one row of the work table: both sides are copied to the tiles they belong
    to and meet on the tile's key, so that tiles spread over all tasks whatever the number of blocks.
    A tile yields ``k`` entries per query; lists are merged ``FAN_IN`` at a time.

    Vectors that are null, hold null or non-finite components, or have no id take no part; vectors meet
    only others of the same length. A query does not meet rows with its own id; of ties the smaller id
    comes first; a candidate row that is repeated is listed as often. Repeated query rows give repeated
    results. Fewer than ``k`` candidates give fewer rows; empty tables give none. Scores beyond 64 bits
    are clipped to them.
    """
    blocks, n_blocks = _packed(queries, id_col, vector_col, scale, query_rows)
    shards, n_shards = _packed(vectors, id_col, vector_col, scale, shard_rows)
    blocks = blocks.select("dim", F.col("part").alias("q_part"), *[F.col(c).alias(f"q_{c}") for c in ("n", "keys", "ids", "data")])
    blocks = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    shards = shards.withColumnRenamed("part", "run").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tiles = blocks.join(shards, ["dim", "q_part", "run"])
    lists = tiles.mapInPandas(lambda parts: _select(parts, k), LISTS)
    runs = n_shards
    while True:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = lists.groupBy("query_key", "query_id", F.floor(F.col("run") / FAN_IN).alias("run")).agg(best)
        runs = -(-runs // FAN_IN)
        if runs == 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.loss")).alias("score"),
    )


def _packed(df: DataFrame, id_col: str, vector_col: str, scale: int, size: int) -> tuple[DataFrame, int]:
    """The usable vectors in blocks, as a written table, and the number of parts they were dealt to."""
    parts = max(1, -(-df.count() // size))
    rows = df.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"),
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"),
    ).filter("id IS NOT NULL AND v IS NOT NULL")
    dealt = rows.repartition(parts, "part").mapInPandas(lambda batches: _pack(batches, size), PACKED)
    return cut_lineage(dealt), parts
