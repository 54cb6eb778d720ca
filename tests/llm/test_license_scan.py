import random

import numpy as np
import pytest

from tidemark.llm.license_scan import NOTICES, TemplateIndex, align, license_matches, winnowed


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(m.license, m.coverage, m.start, m.end) for m in r.matches] for r in license_matches(df, **options).collect()}


def test_every_notice_is_found_where_it_stands(spark):
    texts = [f"é\U0001F600 before. {t}! after" for _, t in NOTICES]
    got = found(spark, texts)
    for i, (name, text) in enumerate(NOTICES):
        (match,) = got[i]
        assert match[:2] == (name, 1.0)
        assert texts[i][match[2] : match[3]].rstrip(".") == text.rstrip(".")


def test_edited_notices_and_coverage(spark):
    long = "Redistribution and use, in source AND binary forms with or without any modification are permitted"
    got = found(spark, [long, "Licensed under the", "licensed under the apache licence version 2.0", "plain words about a license"])
    ((name, coverage, start, end),) = got[0]
    assert (name, coverage, long[start:end]) == ("bsd", 1.0, long)
    assert got[1] == [] and got[3] == []
    assert got[2][0][0] == "apache-2.0" and got[2][0][1] == pytest.approx(7 / 8)


def test_many_notices_in_a_long_text(spark):
    random.seed(14)
    filler = ["alpha", "beta", "license", "under", "version"]
    parts, wanted = [], []
    for i in range(200):
        parts.append(" ".join(random.choices(filler, k=300)))
        parts.append(NOTICES[i % len(NOTICES)][1])
        wanted.append(NOTICES[i % len(NOTICES)][0])
    got = found(spark, [" | ".join(parts)])
    assert [m[0] for m in got[0]] == wanted


def test_alignment_is_a_longest_common_subsequence_within_the_band():
    random.seed(15)
    for _ in range(200):
        a, b = [np.array(random.choices(range(4), k=random.randint(1, 7)), dtype=np.uint64) for _ in range(2)]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        pairs = align(a, b, 0)
        assert len(pairs) == table[-1, -1]
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_winnowing_keeps_the_smallest_of_every_window():
    random.seed(16)
    owner = np.array([0] * 20 + [1] * 2 + [3] * 9)
    grams = np.array(random.choices(range(100), k=len(owner)), dtype=np.uint64)
    kept = set(winnowed(grams, owner, 4).tolist())
    for o in (0, 1, 3):
        at = np.flatnonzero(owner == o)
        for s in range(max(1, len(at) - 3)):
            window = at[s : s + 4]
            assert any(p in kept and grams[p] == grams[window].min() for p in window)


def test_templates_as_a_table_and_odd_rows(spark, odd_docs, no_docs):
    table = spark.createDataFrame([("own", "You may quote this text freely everywhere"), ("none", None), ("short", "a b")], "name string, text string")
    assert found(spark, ["x you may quote this text freely, everywhere x"], templates=table)[0][0][:2] == ("own", 1.0)
    rows = license_matches(odd_docs).collect()
    assert len(rows) == 12 and all(r.matches == [] for r in rows)
    assert license_matches(no_docs).count() == 0
    assert found(spark, ["Released under the MIT License"], templates=[]) == {0: []}
    assert TemplateIndex(["t"], ["a b c d"]).hits(np.zeros(0, np.uint64))[0].tolist() == []
