"""Hard negatives against a brute-force search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5, positives=5, negatives=3, low=50, high=95, scale=256):
    whole = [(key, i, [math.floor(scale * x) for x in v], label) for key, (i, v, label) in enumerate(rows)
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [r for r in whole if sum(x * x for x in r[2]) < 2**62]
    out = []
    for key, anchor, a, label in whole:
        if anchor % every:
            continue
        pairs = [(-sum(x * y for x, y in zip(a, v)), i, mine) for k, i, v, mine in whole if k != key and len(v) == len(a)]
        for p, positive, _ in sorted(x for x in pairs if x[2] == label)[:positives]:
            fits = sorted((s, i) for s, i, mine in pairs if mine != label and low * -p <= 100 * -s <= high * -p)
            out += [(anchor, positive, rank + 1, i, -p, -s) for rank, (s, i) in enumerate(fits[:negatives])]
    return sorted(out)


def run(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def test_against_brute_force(spark):
    random.seed(3)
    rows = [(i, [random.choice([-0.5, 0.25, 0.1, 0.9]) for _ in range(5)], random.choice([0, 0, 0, 1, 2])) for i in range(-40, 200)]  # many ties
    wanted = brute(rows)
    assert len(wanted) > 200 and run(spark, rows) == wanted
    assert run(spark, rows, resident=7, block_rows=11) == wanted
    assert run(spark, rows, low=0, high=100, positives=2, negatives=9) == brute(rows, low=0, high=100, positives=2, negatives=9)


def test_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [-0.7, 0.0], 2), (6, [0.0, -3.0], 3)]
    assert run(spark, rows) == brute(rows) == [(0, 2, 1, 3, 0, 0), (0, 2, 2, 6, 0, 0)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 0.0], 2), (4, [inf, 0.0], 1), (None, [1.0, 1.0], 1), (5, [1.0, 2.0], None),
            (6, [0.9, 2.0], 1), (7, [0.5, 1.2], 2), (8, [1.0, 2.0, 3.0], 1), (10, [], 1), (15, [], 2), (20, [1e300, 0.0], 1), (21, [2.0**23, 1.0], 2),
            (25, [2.0**21, 1.0], 1), (26, [2.0**21, -1.0], 1), (27, [2.0**20, 1.0], 2), (30, [1.0] * 1500, 4), (31, [1.0] * 1500, 4), (32, [0.75] * 1500, 5)]
    wanted = brute(rows)
    assert run(spark, rows) == wanted and {r[0] for r in wanted} == {0, 25, 30}


def test_repeated_rows(spark):
    rows = [(5, [1.0], 1), (5, [1.0], 1), (6, [0.75], 2), (6, [0.75], 2), (7, [0.75], 2), (7, [0.75], 2)]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 6


def test_empty_and_clashing(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0], 1)]) == []
    names = "vec_id long, embedding array<double>, label int, row string, id string, v int, anchor string, score string, scores int"
    rows = [(5, [1.0], 1), (6, [0.9], 1), (7, [0.75], 2)]
    df = spark.createDataFrame([(*r, *[None] * 6) for r in rows], names)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") == 5).collect())) == brute(rows)


def test_windows_within_the_positive(spark):
    with pytest.raises(ValueError):
        hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True), low=10, high=120)
