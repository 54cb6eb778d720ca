import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bag_minhash
from tidemark.llm.bag_minhash import drop_near_duplicates, near_duplicates, shingle_counts, shingle_sets, signatures
from tidemark.llm.components import components, merged

WHITE = "\t\n\x0b\x0c\r "


def words(text):
    out = [""]
    for c in text or "":
        if c in WHITE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def shingles(text, width=5):
    w = words(text)
    return Counter([tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]) if w else Counter()


def similarity(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 0.0


def brute(rows):
    bags, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    ids = sorted(bags)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if similarity(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(text, n, rng):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    sources = [" ".join(f"v{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 300]))) for _ in range(25)]
    shared = " ".join(f"common{i}" for i in range(60))
    texts = []
    for s in sources:
        texts += [s, s, s + " "] + [edited(s, rng.choice([1, 1, 2, 4, 9]), rng) for _ in range(6)]
        texts.append(shared + " " + s)
    texts += ["spam " * 200, "spam " * 230, "spam " * 300, "a b", "a b", "a b c", "", None, "  "]
    return list(enumerate(texts))


def test_against_brute_force(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(4)
    found = near_duplicates(df).collect()
    groups = brute(planted)
    size = Counter(groups.values())
    assert {r.doc_id: (r.group_id, r.group_size, r.kept) for r in found} == {i: (g, size[g], i == g) for i, g in groups.items()}
    left = drop_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in left) == sorted(set(groups.values()))


def test_joins_beyond_the_broadcast_bound(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string")
    spark.conf.set("tidemark.broadcastBytes", "0")
    try:
        found = near_duplicates(df).collect()
    finally:
        spark.conf.unset("tidemark.broadcastBytes")
    assert {r.doc_id: r.group_id for r in found} == brute(planted)


def test_crowded_buckets(spark, monkeypatch):
    """Many texts that share much but not enough, in one bucket: pivots, cuts by other bands, and the rest."""
    rng = random.Random(12)
    core = " ".join(f"c{i}" for i in range(60))
    rows = []
    for i in range(60):
        own = core + " " + " ".join(f"o{i}x{k}" for k in range(30))
        rows += [own, edited(own, 1, rng)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(bag_minhash, "PIVOT_ROUNDS", 1)
    monkeypatch.setattr(bag_minhash, "PAIRS_PER_ROW", 1)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in found} == brute(rows)


def test_links_do_not_depend_on_the_size_of_buckets(spark, monkeypatch):
    """With few bands many pairs share one band only; they are no links, whether or not their buckets are cut."""
    rng = random.Random(15)
    rows = []
    for i in range(60):
        own = " ".join(f"w{i}x{k}" for k in range(80))
        rows += [own, edited(own, 1, rng), edited(own, 1, rng)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    groups = lambda: {r.doc_id: r.group_id for r in near_duplicates(df, bands=4).collect()}
    whole = groups()
    monkeypatch.setattr(bag_minhash, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(bag_minhash, "PAIRS_PER_ROW", 0)
    assert groups() == whole


def test_signatures_estimate_weighted_jaccard():
    texts = ["a b c d e f g h " * 30, "a b c d e f g h " * 60, "a b c d e f g h " * 30 + "x y z " * 40, "q " * 500, "q " * 400]
    owner, hashes, counts = shingle_counts(pa.array(texts), 5)
    made = signatures(owner, hashes, counts, len(texts), 4096)
    bags = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert np.mean(made[i] == made[j]) == pytest.approx(similarity(bags[i], bags[j]), abs=0.035)
    alone = [signatures(*shingle_counts(pa.array([t]), 5), 1, 4096)[0] for t in texts]
    assert all((a == m).all() for a, m in zip(alone, made))


def test_sets_overlap_as_multisets_do():
    texts = ["a a a a a a a", "a a a a a a", "a b c", "", "a b c d e f a b c d e"]
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts), 5)]
    bags = [shingles(t) for t in texts]
    for a, x in zip(bags, sets):
        for b, y in zip(bags, sets):
            assert len(x & y) == sum((a & b).values()) and len(x) == sum(a.values())


def test_components(spark):
    rng = random.Random(13)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 120), (120, 110), (7, 7), (300, 301), (301, 300)] + [(500, 500 + rng.randrange(1, 90)) for _ in range(80)]
    rng.shuffle(links)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[110] == got[120] == 100 and got[301] == 300
    assert {got[b] for a, b in links if a == 500} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_further_links(spark):
    rng = random.Random(14)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    links = [(a, b) for a, b in links if a != b]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    whole = {(r.node, r.label) for r in components(frame(links)).collect()}
    parts = merged(merged(components(frame(links[:10])), frame(links[10:25])), frame(links[25:]))
    assert {(r.node, r.label) for r in parts.collect()} == whole


def test_odd_rows(odd_docs, no_docs):
    found = near_duplicates(odd_docs).collect()
    assert len(found) == 12
    groups = Counter((r.group_id, r.group_size) for r in found)
    assert groups[1, 3] == 3 and groups[8, 2] == 2 and groups[6, 1] == 1
    assert sorted(r.kept for r in found if r.group_id == 8) == [False, True]
    left = drop_near_duplicates(odd_docs)
    assert left.schema.simpleString() == odd_docs.schema.simpleString()
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "5", "6", "7", "8", "9", "None"]
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0


def near_copies(n: int, seed: int) -> list[tuple[int, str]]:
    """Copies of one text with none to many words changed: many share bands, nearer ones are links."""
    rng = random.Random(seed)
    whole = " ".join(f"w{i}" for i in range(150))
    return [(i, edited(whole, i % 9, rng)) for i in range(n)]


def test_pivots_link_a_group_from_its_middle(spark, monkeypatch):
    """What the first pivots leave to compare pair by pair is far less than the group's pairs."""
    rows = near_copies(120, 21)
    verified, real = [], bag_minhash._verified
    monkeypatch.setattr(bag_minhash, "PAIRS_PER_ROW", 1)
    monkeypatch.setattr(bag_minhash, "_verified", lambda pairs, *rest: verified.append(pairs.count()) or real(pairs, *rest))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in found} == brute(rows)
    assert sum(verified) < 120 * 12


def test_buckets_stay_whole_where_a_cut_gives_no_fewer_pairs(spark, monkeypatch):
    cuts, real = [], bag_minhash._cut
    monkeypatch.setattr(bag_minhash, "_cut", lambda *args: cuts.append(real(*args)) or cuts[-1])
    monkeypatch.setattr(bag_minhash, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(bag_minhash, "PAIRS_PER_ROW", 0)
    rows = near_copies(60, 22)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in found} == brute(rows)
    rng = random.Random(23)
    core = " ".join(f"c{i}" for i in range(60))
    rows = [(i, edited(core + " " + " ".join(f"o{i}x{k}" for k in range(60)), 1, rng)) for i in range(60)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in found} == brute(rows)
    assert [cut is None for cut in cuts] == [True, False]
