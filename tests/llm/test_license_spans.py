import random
import re

import numpy as np
from test_license_scan import found

from tidemark.llm.license_scan import NOTICES, Pattern, default_templates
from tidemark.llm.queries import op3_license_scan


def test_copies_in_a_row_small_edits_and_long_insertions(spark):
    mit = "Released under the MIT License."
    body = " ".join(f"w{i}" for i in range(300))
    longer = " ".join(f"w{i}" if i % 6 else f"w{i} extra{i}" for i in range(300))  # 50 words more
    texts = [f"{mit} " * 3, f"{mit}\n" * 40, "x Released under an MIT License x", f"Released under an MIT License {mit}", f"a b {longer} c d"]
    got = found(spark, texts, templates=[*NOTICES, ("body", body)])
    assert [m[:2] for m in got[0]] == [("mit", 1.0)] * 3 and [m[:2] for m in got[1]] == [("mit", 1.0)] * 40
    assert [m[:2] for m in got[2]] == [("mit", 0.8)] and texts[2][got[2][0][2] : got[2][0][3]] == "Released under an MIT License"
    assert [m[1] for m in got[3]] == [0.8, 1.0]
    ((name, coverage, start, end),) = got[4]
    assert (name, coverage, texts[4][start:end]) == ("body", 1.0, longer)


def test_spans_against_every_span_by_brute_force():
    def common(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        return table

    random.seed(17)
    some = 0
    for _ in range(120):
        n = random.choice([3, 4, 5, 6, 7, 10])
        template = random.choices(range(12), k=n)
        pattern = Pattern(np.array(template, np.uint64), 3, 0.8)
        text = []
        for _ in range(random.randint(1, 3)):
            copy = [t if random.random() > 0.1 else random.randrange(20) for t in template]
            text += random.choices(range(20), k=random.choice([0, 0, 3, 12])) + copy
        runs = {tuple(template[i : i + pattern.run]) for i in range(n - pattern.run + 1)}
        marks = [i for i in range(len(text)) if tuple(text[i : i + pattern.run]) in runs]
        got = list(pattern.spans(pattern.places(np.array(text, np.uint64)), marks, 0, len(text)))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        for s, e, count in got:
            assert e - s <= pattern.most and count >= pattern.need and common(template, text[s:e])[-1, -1] == count
        free = [(a[1], b[0]) for a, b in zip([(0, 0), *got], [*got, (len(text), 0)])]
        for lo, hi in free:
            for s in range(lo, hi):
                e = min(hi, s + pattern.most)
                ends = np.flatnonzero(common(template, text[s:e])[-1] >= pattern.need)
                if len(ends) and pattern.could(pattern.places(np.array(text[s:e], np.uint64))):
                    assert not any(s <= m and m + pattern.run <= e for m in marks)
        some += len(got)
    assert some > 100


def test_every_default_template_is_found_whole_and_edited(spark):
    templates = default_templates()
    names = [n for n, _ in templates]
    random.seed(18)
    edited = []
    for _, text in templates:
        parts = text.split()
        plain = [i for i, w in enumerate(parts) if w.isalpha() and w.islower()]  # not what tells licenses apart
        for i in random.sample(plain, len(plain) // 20):
            parts[i] = "zzz"
        edited.append(f"é before, {' '.join(parts)} after")
    got = found(spark, [f"é before, {t} after" for _, t in templates] + edited)
    for i, name in enumerate(names):
        assert [m[:2] for m in got[i]] == [(name, 1.0)]
        best = max(got[len(names) + i], key=lambda m: m[3] - m[2])
        assert best[0] == name and best[1] >= 0.9


def test_query_against_a_search_of_every_template(spark):
    def folded(text):
        return "".join(f" {w} " for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower()))

    path = "/root/testdata/sf0.01"
    rows = op3_license_scan(spark, path).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    templates = [(name, folded(text)) for name, text in default_templates()]
    count = {name: 0 for name, _ in templates}
    for doc, text in docs.items():
        found_here = [folded(text[r.start : r.end]) for r in rows if r.doc_id == doc]
        for name, template in templates:
            n = folded(text).count(template)
            count[name] += n
            assert sum(span.count(template) for span in found_here) == n
    assert count["all-rights-reserved"] > 0
