import math
import random

import numpy as np

from tidemark.llm.topk_search import _products, topk_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, scale=1024, every=10):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every:
            continue
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(b) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk_search(df, df.filter("vec_id % 10 = 0"), **options).collect()))


def test_against_brute_force(spark):
    random.seed(1)
    rows = [(i, [random.choice([-0.5, 0.25, 0.1, 0.9]) for _ in range(4)]) for i in range(-20, 180)]  # many ties
    assert run(spark, rows, k=10, query_rows=4, shard_rows=16) == brute(rows, 10)
    assert run(spark, rows, k=3) == brute(rows, 3)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]),
            (5, [1.0, -2.0]), (6, [1.0, 2.0, 3.0]), (10, []), (20, []), (7, [3e9, 3e9]), (30, [-0.0004, 0.0]), (8, [1.0] * 2000), (40, [2.0] * 2000)]
    assert run(spark, rows, k=4) == brute(rows, 4)


def test_repeated_rows_and_few_candidates(spark):
    rows = [(10, [1.0]), (11, [0.5]), (11, [0.5])]
    assert run(spark, rows, k=5) == [(10, 1, 11, 1024 * 512), (10, 2, 11, 1024 * 512)]
    assert run(spark, [(10, [1.0])], k=5) == []
    assert run(spark, [], k=5) == []


def test_products_beyond_floating_point():
    big = np.array([[2**40, 3]], dtype=np.int64)
    assert _products(big, np.array([[2**20 + 1, 1]], dtype=np.int64)).tolist() == [[2**60 + 2**40 + 3]]
    assert _products(big, np.array([[2**40, 1]], dtype=np.int64)).tolist() == [[2**63 - 1]]
