import hashlib
import math
import random
import re

import pytest

from tidemark.llm import secret_scan as scan
from tidemark.llm.secret_scan import WORDS, guess_cost, ranks, secret_spans, span_digest

KNOWN = ranks(WORDS)
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_kinds_against_their_patterns(spark):
    random.seed(4)
    bits = ["password", "PassWd", "toKen", "paſſword", "token", "api_key", "apikey", " ", " = ", ":", "'", '"', "AKIA", "AKIAAKIA", "0123456789ABCDEF",
            "deadbeef" * 4, "cafe", "é\U0001F600", "Zz9+/_.=-", "\n", "secret", "x"]
    texts = ["".join(random.choices(bits, k=random.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in span_digest(secret_spans(df)).collect():
        wanted = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in wanted)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("guess")) == joined
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[0] == k for w in wanted) for k in ("assign", "access", "hex"))


@pytest.mark.parametrize("easy,hard", [("password1", "xK9-vQ2_wL"), ("qwertyuiop", "qzxwplmvto"), ("aaaaaaaaaaaa", "kfnwudnvpqoz"),
                                       ("19900214", "70312945"), ("letmein2020", "l7tgeiqw9d0"), ("P@ssw0rd", "Pz$xv0qd")])
def test_guess_cost_orders_values(easy, hard):
    assert guess_cost(easy, KNOWN) < 7 < guess_cost(hard, KNOWN)


def cheapest(value):
    """Every cut into spans of one pattern each; brute-force spans never stand next to each other."""
    def price(part):
        options = [scan._word_cost(part, KNOWN)] if 3 <= len(part) <= scan.LONGEST_WORD else []
        options += [scan.DATE_COST] if scan.DATE.fullmatch(part) else []
        options += [scan.YEAR_COST] if scan.YEAR.fullmatch(part) else []
        if len(part) >= 3 and len(set(part)) == 1:
            options.append(math.log10(36 * len(part)))
        if len(part) >= 3 and all(p in scan.STEPS for p in zip(part.lower(), part.lower()[1:])):
            options.append(math.log10(94 * len(part)))
        return min((o for o in options if o is not None), default=None)

    def best(i, after_brute):
        if i == len(value):
            return 0.0
        extra = scan.NEXT_SEGMENT if i else 0.0
        costs = []
        for j in range(i + 1, len(value) + 1):
            if not after_brute:
                costs.append(j - i + extra + best(j, True))
            if (p := price(value[i:j])) is not None:
                costs.append(p + extra + best(j, False))
        return min(costs, default=math.inf)
    return best(0, False)


def test_guess_cost_is_the_cheapest_cut():
    random.seed(5)
    for _ in range(40):
        value = "".join(random.choices(["the", "a", "9", "abc", "X", "dog", "pass", "111", "2019"], k=random.randint(1, 4)))[:9]
        assert guess_cost(value, KNOWN) == pytest.approx(cheapest(value))


def test_context_values(spark):
    texts = ["pwd: hunter", "pwd: v9Xq2LmZ7w", "private_key='tR8$kQ!zW2'", "my token ring is red", "Credential = the"]
    rows = secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "guess"] for r in rows}
    assert found == {0: [], 1: ["v9Xq2LmZ7w"], 2: ["tR8$kQ!zW2"], 3: [], 4: []}


def test_odd_rows(odd_docs, no_docs):
    rows = span_digest(secret_spans(odd_docs)).collect()
    assert len(rows) == 12 and all(r.spans == "" for r in rows)
    assert sum(r.doc_id is None for r in rows) == 2
    assert span_digest(secret_spans(no_docs)).count() == 0


def test_very_long_value(spark):
    value = "aB3" * 40_000
    row = secret_spans(spark.createDataFrame([(1, "token=" + value)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("assign", 0, 120_006), ("guess", 6, 120_006)]


def test_long_words_are_listed_whole():
    word = "abracadabrahocuspocusx"
    known = ranks([word])
    assert known == {word: 1} and guess_cost(word, known) < 1 and guess_cost(word[:16] + "qqzzvv", known) > 10
