import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from tidemark.llm.queries import ORACLES, PIECES, QUERIES
from tidemark.session import cut_lineage

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]) if w else Counter()


def test_stages_in_order(stages):
    assert [name for name, _ in stages[1:]] == ["quality classifier", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    assert all(docs.columns == COLUMNS for _, docs in stages[:-1])
    kept = [{r.doc_id for r in docs.select("doc_id").collect()} for _, docs in stages]
    assert all(later <= earlier for earlier, later in zip(kept, kept[1:])) and kept[-1]


def test_quality_keeps_good_documents(spark, stages):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in stages[1][1].collect()}
    good, bad = [d for d, y in label.items() if y], [d for d, y in label.items() if not y]
    assert sum(d in left for d in good) >= 0.98 * len(good) and sum(d in left for d in bad) <= 0.2 * len(bad)


def test_no_copies_are_left(stages):
    before = {r.doc_id: r.text for r in stages[1][1].collect()}
    white = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in before.items()}
    smallest = {}
    for d in sorted(white):
        smallest.setdefault(white[d], d)
    once = {r.doc_id for r in stages[2][1].collect()}
    assert once == set(smallest.values())
    bags, group = {d: bag(before[d]) for d in once}, {d: d for d in once}
    def find(d):
        while group[d] != d:
            d = group[d]
        return d
    for a in sorted(once):
        for b in once:
            if a < b and (either := sum((bags[a] | bags[b]).values())) and sum((bags[a] & bags[b]).values()) >= 0.8 * either:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages[3][1].collect()} == {find(d) for d in once}


def test_mix_and_ids(stages):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in stages[3][1].collect()}
    mixed = stages[4][1].collect()
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert all(taken[d] <= 2 * size[d] for d in taken)
    assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.02
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    wanted = Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in mixed)
    rows = stages[5][1].collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == wanted and all(r.round_trip for r in rows)


def test_run_is_the_stages(spark, stages):
    got, wanted = corpus_pipeline.run(spark, SF), stages[-1][1]
    assert got.columns == wanted.columns and got.count() == wanted.count()


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    """Nulls, repeats and extra columns named like the operators' own, through every stage; and no rows at all."""
    spark.createDataFrame([(i, 1) for i in range(12)] + [(None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = cut_lineage(stage(spark, docs, str(tmp_path)))
            if name != "sentencepiece":
                assert after.schema.simpleString() == docs.schema.simpleString(), name
            assert (after.count() > 0) == (docs.count() > 0)
            docs = after


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
