import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import STATISTICS, RuleEnsemble, fit_rules, holds, keep_good, score_documents, simplified, statistics, tree_rules

SF = "/root/testdata/sf0.01"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = score_documents(docs, labels).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == out(r.doc_id) for r in found)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    tested = [r for r in found if r.held_out and r.doc_id in quality]
    assert auc([(r.score, quality[r.doc_id]) for r in tested]) > 0.97
    assert sum(r.predicted == quality[r.doc_id] for r in tested) / len(tested) > 0.95
    # labels of held-out rows, and columns other than the text, change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = score_documents(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), flipped).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in found}


def test_statistics_of_small_texts():
    rows = statistics(pa.array(["", " \n", "Ab c1 AB!\nab", "a a a a", "É\n\n"]))
    named = [dict(zip(STATISTICS, r)) for r in rows.tolist()]
    assert rows[0].tolist() == rows[1].tolist() == [0.0] * len(STATISTICS)
    assert named[2]["upper"] == pytest.approx(3 / 12) and named[2]["digits"] == pytest.approx(1 / 12) and named[2]["marks"] == pytest.approx(1 / 12)
    assert named[2]["upper_words"] == 0.25 and named[2]["digit_words"] == 0.25 and named[2]["marked_words"] == 0.25 and named[2]["distinct_words"] == 1
    assert named[2]["line_words"] == 2 and named[2]["word_length"] == 2.25
    assert named[3]["distinct_words"] == 0.25 and named[3]["distinct_triples"] == 0.5
    alone = [statistics(pa.array([t]))[0].tolist() for t in ["", " \n", "Ab c1 AB!\nab", "a a a a", "É\n\n"]]
    assert [pytest.approx(a) for a in alone] == rows.tolist()


def test_rules_from_a_printed_tree(spark):
    text = """DecisionTreeClassificationModel: depth=2, numNodes=5
  If (feature 3 <= 0.5)
   If (feature 1 <= 2.25E-4)
    Predict: 0.0
   Else (feature 1 > 2.25E-4)
    Predict: 1.0
  Else (feature 3 > 0.5)
   Predict: 1.0
"""
    assert tree_rules(text) == [((3, "<=", 0.5),), ((3, "<=", 0.5), (1, "<=", 2.25e-4)), ((3, "<=", 0.5), (1, ">", 2.25e-4)), ((3, ">", 0.5),)]
    assert simplified(((0, "<=", 3.0), (1, ">", 1.0), (0, "<=", 2.0), (1, ">", 4.0))) == ((0, "<=", 2.0), (1, ">", 4.0))
    df = spark.createDataFrame([([1.0, 5.0],), ([2.5, 5.0],), ([1.0, 4.0],)], "stats array<double>")
    assert [r[0] for r in df.select(holds(((0, "<=", 2.0), (1, ">", 4.0)))).collect()] == [1.0, 0.0, 0.0]
    score = RuleEnsemble([(((0, "<=", 2.0),), 1.0)], 0.0).score()
    assert [round(r[0], 4) for r in df.select(score).collect()] == [0.7311, 0.5, 0.7311]


def test_fit_finds_a_planted_rule(spark, folder):
    random.seed(8)
    rows = [(i, [random.random(), random.random()]) for i in range(600)]
    rows = [(i, x, int(not (x[0] > 0.6 and x[1] < 0.5))) for i, x in rows]
    df = spark.createDataFrame(rows, "key long, stats array<double>, label int")
    model = fit_rules(df)
    scored = df.select("label", model.score().alias("s")).collect()
    assert auc([(r.s, r.label) for r in scored]) > 0.99
    assert 0 < len(model.rules) < 120 and len(model.describe()) == len(model.rules)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (5, 1)], 2.5 / 3), ([(1, None), (5, 7)], 0.5), ([(1, 0), (5, 0)], 0.5 / 3)])
def test_without_both_labels(spark, odd_docs, labels, score):
    known = [(i, y) for i, y in labels if not out(i)]
    df = spark.createDataFrame(labels, "doc_id long, quality int")
    found = score_documents(odd_docs, df).collect()
    wanted = (sum(y for _, y in known if y in (0, 1)) + 0.5) / (sum(y in (0, 1) for _, y in known) + 1)
    assert len(found) == 12 and all(r.score == pytest.approx(wanted) for r in found)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1)], "doc_id long, quality int")
    found = score_documents(odd_docs, labels).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 for r in found)
    assert score_documents(no_docs, labels).count() == 0
    left = keep_good(odd_docs, labels, threshold=0.0)
    assert left.schema.simpleString() == odd_docs.schema.simpleString() and left.count() == 12
    assert keep_good(no_docs, labels).count() == 0
