"""Phrases against counting every run of words, and the index against the text itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.phrase_index import Index, extensions, packed, thinned, unpacked
from tidemark.llm.phrases import mine_phrases, phrase_counts

SCHEMA = "doc_id long, text string, lang string"


def counted(rows, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts, n


def brute(rows, least=100, top=2000, longest=5):
    counts, n = counted(rows, longest)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, parts=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, mine_phrases(df, **options).collect()))


def sentences(seed, n, words="a b c D the of The x1 é 中文 \x1c-".split(" ")):
    random.seed(seed)
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "\x0b", "!? ", " \r\n"]
    rows = []
    for i in range(n):
        text = "".join(random.choice(words) + random.choice(marks) for _ in range(random.randint(0, 60)))
        rows.append((i, text + random.choice(["", "the quick brown fox jumps over"]), random.choice(["en", "fr", None, "und"])))
    return rows


def test_against_counting(spark):
    rows = sentences(1, 300)
    wanted = brute(rows, least=12)
    assert len(wanted) > 100 and any(len(r[2].split(" ")) == 5 for r in wanted)
    assert run(spark, rows, least=12) == wanted
    assert run(spark, rows, parts=40, least=12, bucket_bytes=500) == wanted
    assert run(spark, rows, parts=1, least=12, top=7, longest=3) == brute(rows, 12, 7, 3)


def test_counts_of_every_length(spark):
    rows = sentences(2, 200)
    tables, totals = phrase_counts(spark.createDataFrame(rows, SCHEMA).repartition(9), least=8)
    counts, n = counted(rows)
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(n)
    for m, found in enumerate(tables, 1):
        wanted = {(lang, " ".join(p)): a for lang, f in counts.items() for p, a in f.items() if len(p) == m and a >= 8}
        assert {(r["lang"], r["phrase"]): r["f"] for r in found.collect()} == wanted


def test_exact_beyond_64_bits(spark):
    rows = [(2**62, 2**62, 3, 2**61), (999_999_999_999_999_999, 10**12 + 7, 10**9 + 7, 10**13), (100, 100, 100, 10**13)]
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    frame = spark.createDataFrame(rows, "a long, l long, r long, n long")
    score = F.expr("(CAST(1000 * CAST(a AS DECIMAL(19, 0)) AS DECIMAL(23, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    got = [r[0] for r in frame.filter(whole("a") < 2**61).select(score).collect()]
    assert got == [1000 * a * n // (left * r) for a, left, r, n in rows if a < 2**61]


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, mine_phrases(odd_docs, least=1, top=100_000, longest=3).collect())) == brute(rows, 1, 100_000, 3)
    assert mine_phrases(no_docs).collect() == []
    assert run(spark, [(1, None, None), (2, "", "en"), (3, " .\n", "en")], least=1) == []


def test_long_texts_are_cut_where_pieces_end(spark):
    random.seed(3)
    text = "".join(random.choice(["alpha ", "beta ", "gamma. ", "delta, "]) for _ in range(900_000))  # several portions
    rows = [(1, text, "en"), (2, "no end " * 400_000, "en")]  # the second has no piece to cut at
    assert run(spark, rows, least=1000) == brute(rows, 1000)


def test_index():
    rng = np.random.default_rng(4)
    for _ in range(30):
        text = thinned(rng.integers(0, 4, rng.integers(0, 200)))
        for length in (1, 2, 3):
            runs = Counter(tuple(text[i : i + length].tolist()) for i in range(len(text) - length + 1) if text[i : i + length].all())
            phrases = np.array(sorted(runs), np.int64).reshape(-1, length)
            low, high = Index(text, length).find(phrases)
            assert (high - low).tolist() == [runs[tuple(p)] for p in phrases.tolist()]
            if length == 1:
                phrases = np.arange(1, int(text.max(initial=0)) + 1)[:, None] if len(phrases) == text.max(initial=0) else phrases
            some = phrases[rng.random(len(phrases)) < 0.7] if length > 1 else phrases
            word, line, counts, less = extensions(text, some)
            longer = Counter(tuple(text[i : i + length + 1].tolist()) for i in range(len(text) - length) if text[i : i + length + 1].all())
            known = set(map(tuple, some.tolist()))
            wanted = {p: a for p, a in longer.items() if p[1:] in known and (length == 1 or p[:-1] in known)}
            assert {(w, *some[i].tolist()): a for w, i, a in zip(word.tolist(), line.tolist(), counts.tolist())} == wanted
            kept = Counter(tuple(less[i : i + length].tolist()) for i in range(len(less) - length + 1))
            assert all(kept[p] == runs[p] for p in known if p in runs)


def test_packing():
    for values in ([], [0], [5, -1, 2**31], [2**62, 3], list(range(1000))):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values
