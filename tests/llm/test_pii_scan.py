"""Personal data: base kinds against plain regular expressions, added kinds by example."""

import hashlib
import random
import re
import time

import pytest

from tidemark.llm.pii_scan import BASE, KINDS, automaton, find_spans, luhn, pii_digest, pii_spans

SF = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def cues():
    return automaton()


def base(text, cues):
    return [s for s in find_spans(text, cues) if s[0] in BASE]


def added(text, cues):
    return [(k, text[a:b]) for k, a, b in find_spans(text, cues) if k not in BASE]


def test_base_spans_on_random_strings(cues):
    random.seed(5)
    for alphabet in ("a1.@-", "0123.", "12 -", "+1 ().-2a", "a@b.c1+ -é:25"):
        for _ in range(4000):
            text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
            assert base(text, cues) == brute(text), text
    for _ in range(2000):  # long runs of digits, so that some pass the check
        text = "".join(random.choice("0123456789 -") for _ in range(random.randint(14, 60)))
        assert base(text, cues) == brute(text), text


def test_base_spans_by_hand(cues):
    text = "x@y é a.b+c@mail.example.com, 256.1.1.1.1 10.0.0.1; 4111 1111-1111 1111; +1 (319) 555-5132."
    assert [(k, text[a:b]) for k, a, b in base(text, cues)] == [
        ("email", "a.b+c@mail.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (319) 555-5132"),
    ]
    assert base("0000000000000000000255.1.1.1 " + "9" * 5000 + ".1.1.1", cues)[0] == ("ip", 0, 28)
    assert base("4111111111111111" * 2, cues) == []


@pytest.mark.parametrize("text, wanted", [
    ("jörg@bücher.example", [("mail", "jörg@bücher.example")]),
    ("root@[10.0.0.1]", [("mail", "root@[10.0.0.1]")]),
    ("ann.lee (at) example [dot] org", [("mail", "ann.lee (at) example [dot] org")]),
    ("ann[at]example.org", [("mail", "ann[at]example.org")]),
    ("Tel: (030) 123 45 67.", [("tel", "(030) 123 45 67")]),
    ("postgres://svc:pa55@db/x https://example.org/@x", [("login", "svc:pa55")]),
    ("at fe80::1:2 and 2001:0db8:0:0:0:0:0:1, not 12:30:45 or a::b", [("ip6", "fe80::1:2"), ("ip6", "2001:0db8:0:0:0:0:0:1")]),
    ("00:1B:44:11:3a:b7 00-1b-44-11-3a-b7 00-1b-44", [("mac", "00:1B:44:11:3a:b7"), ("mac", "00-1b-44-11-3a-b7")]),
    ("IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE88370400440532013000",
     [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]),
    ("Account no. 1234 5678 90; accountant: 123456", []),
    ("Account no: 1234 5678 90, Konto 5", [("account", "1234 5678 90")]),
    ("SSN: 123-45-6789, ssn 000-12-3456, 123-45-6789", [("ssn", "123-45-6789")]),
])
def test_added_kinds(cues, text, wanted):
    assert added(text, cues) == wanted


def test_long_texts(cues):
    for part in ("a", "1", "1.", "a@", "+1", "1 ", "a:", "::", "1-", "de8", "ab-", "é", "://a@", "(at)"):
        text = part * 2000
        assert base(text, cues) == brute(text)
        began = time.process_time()
        find_spans(part * 100_000, cues)  # the parsers take time in proportion, whatever stands in a text
        assert time.process_time() - began < 10


def test_whole_table(spark, cues):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in pii_digest(pii_spans(docs)).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        wanted = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(wanted, key=lambda s: (KINDS.index(s[0]), s[1])))
        row = got[doc_id]
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in wanted) for k in BASE]
        assert row["spans"].startswith(joined)
    assert sum(r["n_email"] for r in got.values()) and sum(r["n_card"] for r in got.values())


def test_odd_rows(spark, odd_docs, no_docs):
    found = pii_spans(odd_docs.withColumnRenamed("score", "spans"))
    assert found.columns == ["doc_id", "spans"] and found.count() == odd_docs.count()
    assert pii_digest(pii_spans(no_docs)).collect() == []
    assert {r["spans"] for r in pii_digest(pii_spans(spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string"))).collect()} == {""}
