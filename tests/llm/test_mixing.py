import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.digest_tree import normalised
from tidemark.llm.mixing import GOLDEN, GOLDEN_HIGH, mix, mixed_documents, running_total, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Round by round: what is over a full source's limit goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_targets_against_rounds(spark):
    random.seed(6)
    for n in (1, 2, 5, 13):
        sizes = {(None if i == 3 else f"s{i}"): random.choice([0, 1, 50, 900, 10_000]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df, [5, 2, 1], 1.5, 2).collect()}
        assert got == pytest.approx(filled(sizes)) if sum(sizes.values()) else set(got.values()) == {0.0}


def simulate(found, blocks, block_words):
    """The schedule point by point, and every source's stream word by word."""
    by_source = defaultdict(list)
    for r in found:
        by_source[r["source"]].append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in by_source[s]) for s in names}
    target = filled(size)
    width = {s: max(1, min(block_words, math.ceil(size[s] / blocks))) for s in names}
    slots = {s: target[s] / width[s] for s in names}
    total, low, edges = sum(slots.values()), 0.0, []
    for s in names:
        if slots[s] > 0:
            edges.append((low / total, s))
        low += slots[s]
    drawn = Counter()
    for i in range(round(total)):
        u = (i >> 20) * GOLDEN_HIGH + (i & 0xFFFFF) * GOLDEN
        drawn[[s for at, s in edges if at <= u - math.floor(u)][-1]] += 1
    taken = {}
    for s in names:
        n, start = math.ceil(size[s] / width[s]), 0
        for r in sorted(by_source[s], key=lambda r: (r["place"], r["id"])):
            blocks_of = Counter((start + k) // width[s] for k in range(r["size"]))
            taken[r["id"]] = sum(c * sum(1 for e in range(2) if e * n + b < drawn[s]) for b, c in blocks_of.items())
            start += r["size"]
    return taken


def test_against_simulation(spark):
    random.seed(7)
    rows = [(i, "w " * random.choice([0, 1, 3, 40, 200]), random.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in mix(df, blocks=64, block_words=16).collect()}
    facts = df.select("doc_id", "source", F.pmod(F.xxhash64("doc_id", F.sha2(normalised(F.col("text")), 256), F.lit(0)), F.lit(1 << 30)).alias("place")).collect()
    source = {r.doc_id: r.source for r in facts}
    found = [{"id": r.doc_id, "source": r.source, "place": r.place, "size": got[r.doc_id]["size"]} for r in facts]
    assert {i: r.taken for i, r in got.items()} == simulate(found, 64, 16)
    assert all(r["size"] == len(WORD.findall(rows[i][1])) and 0 <= r.taken <= 2 * r["size"] for i, r in got.items())
    total, goal = Counter(), {}
    for i, r in got.items():
        total[source[i]] += r.taken
        goal[source[i]] = r.target
    assert all(abs(total[s] - goal[s]) <= 16 * 8 for s in goal)
    again = {r.doc_id: r.taken for r in mix(df.repartition(5), blocks=64, block_words=16).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_running_total(spark):
    rows = [(p, place, v) for p in (0, 1) for place, v in [(5, 1), (2_000_000, 7), (1030, 3), (5_000_000, 2), (6, 4)]]
    df = spark.createDataFrame(rows, "part int, place long, v long")
    got = {(r.part, r.place): r.before for r in running_total(df, "part", "place", ["place"], "v", "before").collect()}
    assert got == {(p, x): sum(v for q, y, v in rows if q == p and y < x) for p, x, _ in rows}


def test_odd_rows(odd_docs, no_docs, spark):
    found = mix(odd_docs).collect()
    assert len(found) == 12 and all(0 <= r.taken <= 2 * r["size"] for r in found)
    assert sum(r["size"] for r in found) == 3 * 6 + 30_000 + 1 + 2 * 2 + 4
    assert mix(no_docs).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()] == [0, 0]


def test_documents_leave_as_often_as_drawn(odd_docs, no_docs):
    kept = odd_docs.dropDuplicates(["doc_id", "text"])
    drawn = {(r.doc_id, r.text_sha256): r.taken for r in mix(kept).collect()}
    out = mixed_documents(kept)
    assert out.schema.simpleString() == kept.schema.simpleString()
    words = out.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(drawn.values())
    assert mixed_documents(no_docs).count() == 0


def test_part_of_a_document(spark):
    df = spark.createDataFrame([(1, "a b  c\nd e f g h", "s", 15)], "doc_id long, text string, source string, n_chars long")
    rows = sorted(mixed_documents(df, blocks=1000).collect(), key=lambda r: -r.n_chars)
    assert [(r.text, r.n_chars) for r in rows] == [("a b  c\nd e f g h", 15), ("a b c d", 7)]


def test_rows_without_an_id_spread(spark):
    """Texts of rows that all lack an id lie in many cells of the order."""
    docs = spark.range(500).selectExpr("CAST(NULL AS long) AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    found = mix(docs, block_words=2, blocks=10_000)
    assert found.count() == 500 and found.agg(F.sum("taken")).first()[0] > 0
    places = docs.select(F.pmod(F.xxhash64("doc_id", F.sha2("text", 256), F.lit(0)), F.lit(1 << 30)).alias("place")).distinct()
    assert places.count() > 490
