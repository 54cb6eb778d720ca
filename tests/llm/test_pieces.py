import random
import re

import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm.pieces import Encoder, Vocabulary, decode, encode, encode_words, split_words
from tidemark.llm.queries import PIECES


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PIECES)


def sample(n, seed=17):
    rng = random.Random(seed)
    chars = "etaoinshrdlu" * 3 + "  \n\t▁" + "0123456789_-./()" + "éñß中文日本あ\x00\U0001F600"
    fixed = ["", " ", "a", "  a  b ", "x" * 500, " " * 40 + "a", "a" + " " * 17 + "b" + " " * 100, "hello<0x0A>\nworld", "<s> </s> <unk>", "▁a▁▁b"]
    return fixed + ["".join(rng.choices(chars, k=rng.randint(0, 200))) for _ in range(n)]


def test_tasks_encode_as_the_library(vocabulary, library):
    texts = sample(2500) + ["".join(random.Random(i).choices(list(vocabulary.ids), k=6)) for i in range(2500)]
    ids, bounds, same = Encoder(vocabulary, [], []).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library.encode(texts)
    assert same.all()


def test_relational_lattice_encodes_as_the_library(spark, vocabulary, library):
    words = sorted({w for t in sample(400) + ["The words of a sentence, 中文 words\U0001F600"] for w in re.findall(" *[^ ]+| +", " " + t.replace("▁", " "))})
    got = {r.word: list(r.ids) for r in encode_words(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()}
    assert got == {w: vocabulary.merge(w) for w in got}
    regular = [w for w in words if len(w) <= 61 and "  " not in w and any(c in vocabulary.ids for c in w)]
    assert set(regular) <= set(got)
    starts = [w for w in got if w.startswith(" ") and w != " "]
    assert [got[w] for w in starts] == library.encode([w[1:] for w in starts])


def test_words_in_spark_and_in_tasks_agree(spark):
    texts = [t for t in sample(100) if "\x00" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.w for r in df.select("i", split_words(df.t).alias("w")).collect()}
    assert got == {i: re.findall(" *[^ ]+| +", " " + t.replace("▁", " ")) if t else [] for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [0, 30, 100_000])
def test_documents(spark, vocabulary, library, most):
    texts = sample(200, seed=most) + ["the same words again"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = encode(df, vocabulary, dictionary_words=most)
    rows = out.collect()
    assert {r.doc_id: list(r.ids) for r in rows} == dict(enumerate(library.encode(texts)))
    assert all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in decode(out, vocabulary).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_decoding_bytes(spark, vocabulary, library):
    rows = [[], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], library.encode("a b")]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(9, None)], "i int, ids array<int>")
    assert {r.i: r.text for r in decode(df, vocabulary).collect()} == {0: "", 1: "\ufffd", 2: "é", 3: "a b", 9: ""}


def test_odd_rows(odd_docs, no_docs, vocabulary, library):
    rows = encode(odd_docs, vocabulary).collect()
    assert len(rows) == 12 and all(r.round_trip for r in rows)
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id}
    assert {r.doc_id: list(r.ids) for r in rows if r.doc_id} == {i: library.encode(t or "") for i, t in texts.items()}
    assert encode(odd_docs, vocabulary).columns == [c for c in odd_docs.columns if c not in ("text", "ids")] + ["ids", "round_trip"]
    assert encode(no_docs, vocabulary).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model_format

    model = model_format.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        Vocabulary(str(tmp_path / "m.model"))


def test_the_dictionary_does_not_fall_to_zero(spark):
    """More words share the highest counts than the dictionary may hold."""
    from tidemark.llm.pieces import frequent_words

    docs = spark.range(3000).selectExpr("repeat('aa bb cc ', 50) AS text").unionAll(spark.sql("SELECT 'dd dd' AS text"))
    assert {r.word for r in frequent_words(docs, "text", " ", 2).collect()} == {" aa", " bb"}
    assert {r.word for r in frequent_words(docs, "text", " ", 100).collect()} >= {" aa", " bb", " cc", " dd"}
    assert frequent_words(docs.limit(0), "text", " ", 2).count() == 0


def test_decoding_odd_ids(spark):
    vocabulary = Vocabulary(PIECES)
    snow = vocabulary.merge(" \u2603")
    rows = [(1, None), (2, []), (3, snow), (4, [int(vocabulary.byte_ids[0xE2])]), (5, vocabulary.merge(" a  b"))]
    found = {r.n: r.text for r in decode(spark.createDataFrame(rows, "n int, ids array<int>"), vocabulary).collect()}
    assert found[1] == found[2] == "" and found[3] == "\u2603" and "\ufffd" in found[4] and found[5] == "a  b"
