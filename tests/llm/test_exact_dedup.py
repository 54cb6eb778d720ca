import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidemark.llm.exact_dedup import drop_duplicates, exact_dedup


def brute(rows):
    digest = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for i, t in rows}
    groups = defaultdict(list)
    for i, _ in rows:
        groups[digest[i]].append(i)
    return sorted((i, min(groups[digest[i]]), len(groups[digest[i]]), i == min(groups[digest[i]]), digest[i]) for i, _ in rows)


@pytest.mark.parametrize("fan_in,rounds", [(2, 4), (8, 1), (8, None), (3, 2)])
def test_against_brute_force(spark, fan_in, rounds):
    random.seed(fan_in)
    texts = ["hot"] * 150 + [f"t {i % 40}" + random.choice(["", " ", "\n"]) for i in range(250)] + ["a b", "a\t \nb", "a\xa0b", None, ""]
    rows = list(enumerate(random.sample(texts, len(texts)), start=-3))
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), fan_in=fan_in, rounds=rounds)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    found = [r.asDict() for r in exact_dedup(odd_docs).collect()]
    assert len(found) == 12
    words = [r for r in found if r["keep_id"] == 1]
    assert sorted((str(r["doc_id"]), r["kept"], r["group_size"]) for r in words) == [("1", True, 3), ("2", False, 3), ("None", False, 3)]
    assert sorted((str(r["doc_id"]), r["kept"]) for r in found if r["keep_id"] == 3) == [("3", True), ("4", False), ("None", False)]
    assert sorted((r["kept"], r["group_size"]) for r in found if r["doc_id"] == 8) == [(False, 2), (True, 2)]
    assert exact_dedup(no_docs).count() == 0


def test_rows_without_any_id(spark):
    found = exact_dedup(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r.keep_id is None, r.kept, r.group_size) for r in found) == [(True, False, 2), (True, True, 2)]


def test_drop_duplicates_keeps_columns(odd_docs, no_docs):
    left = drop_duplicates(odd_docs)
    assert left.schema.simpleString() == odd_docs.schema.simpleString()
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert drop_duplicates(no_docs).count() == 0


def test_only_dataframe_operations(odd_docs):
    plan = exact_dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
