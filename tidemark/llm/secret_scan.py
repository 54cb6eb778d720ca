"""Secrets in texts: fixed patterns, and values that stand where credentials stand and are hard to guess."""

from __future__ import annotations

import math
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import map_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
NAME = r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|secret)[_-]?key)["']?\x20*[:=]"""
# the word of an authorization scheme stands before the value, unless another name and sign follow it
SCHEME = r"""(?:(?ai:bearer|basic|digest|negotiate|token|api_?key)\x20+["']?(?![^\x20\x09-\x0D"']*""" + NAME + "))?"
CONTEXT = re.compile(NAME + r"""\x20*["']?""" + SCHEME + r"""([^\x20\x09-\x0D"']+)""")
# Common words of chosen passwords, most common first; the place is the number of guesses a word costs.
WORDS = (
    "password pass admin root user test guest login welcome letmein master secret token key hello love monkey dragon"
    " shadow sunshine princess football baseball soccer hockey batman superman killer hunter ranger tiger eagle lion"
    " summer winter spring autumn monday friday sunday january june july august december london paris berlin madrid"
    " coffee cookie banana orange apple cheese pepper ginger flower garden purple silver golden yellow green black"
    " white blue red computer internet server system public private default change changeme example sample dummy demo"
    " office company service account access trust freedom forever family mother father sister brother angel jesus"
    " michael daniel george thomas jordan robert andrew joshua charlie jessica ashley amanda nicole the and for you"
    " that this with have from your none null true false string value text name here your todo"
)
# Runs of neighbouring keys, and of letters and digits in order.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz", "0123456789")
SWAPS = str.maketrans("@4301!$57", "aaeoiisst")
DATE = re.compile(
    r"(?a:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d)"
)
YEAR = re.compile(r"(?:19|20)[0-9]{2}")
LONGEST_WORD = 16
NEXT_SEGMENT = math.log10(2)
DATE_COST, YEAR_COST, BRUTE_COST = math.log10(365 * 120), math.log10(120), 1.0


def _walk_steps() -> set[tuple[str, str]]:
    pairs = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
    return pairs | {(b, a) for a, b in pairs}


STEPS = _walk_steps()


def ranks(words: str | list[str]) -> dict[str, int]:
    """Words with their place, from 1; the first of equal words counts."""
    found: dict[str, int] = {}
    for word in words.split() if isinstance(words, str) else words:
        found.setdefault(word.lower(), len(found) + 1)
    return found


def _word_cost(token: str, known: dict[str, int]) -> float | None:
    """log10 of the guesses for one listed word, its capitals and its swapped signs."""
    lower = token.lower()
    rank, swapped = known.get(lower), 0.0
    if rank is None:
        rank, swapped = known.get(lower.translate(SWAPS)), math.log10(2)
        if rank is None:
            return None
    capitals = sum(c.isupper() for c in token)
    if capitals in (0, 1, len(token)) and not (capitals == 1 and token[0].islower()):
        case = math.log10(2) if capitals else 0.0
    else:
        case = capitals * math.log10(2)
    return math.log10(rank + 1) + swapped + case


def guess_cost(value: str, known: dict[str, int]) -> float:
    """log10 of the fewest guesses: the cheapest way to cut ``value`` into words, dates, repeats, walks and the rest.

    ``best[j]`` is the cheapest cut of the first j characters. Spans that no pattern covers cost a factor of
    ten per character. Every further segment doubles the guesses, except that neighbouring brute-force
    characters are one segment; whether a cut ends in one is kept apart.
    """
    n = len(value)
    lower = value.lower()
    longest = max(LONGEST_WORD, *map(len, known)) if known else 0
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: start and cost
    for pattern, cost in ((DATE, DATE_COST), (YEAR, YEAR_COST)):
        for m in pattern.finditer(value):
            spans[m.end()].append((m.start(), cost))
    same = walk = 0  # where the run of one character, or of neighbouring keys, began
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for j in range(1, n + 1):
        if j > 1 and value[j - 1] != value[j - 2]:
            same = j - 1
        if j > 1 and (lower[j - 2], lower[j - 1]) not in STEPS:
            walk = j - 1
        if j - same >= 3:
            spans[j].append((same, math.log10(36 * (j - same))))
        if j - walk >= 3:
            spans[j].append((walk, math.log10(94 * (j - walk))))
        for i in range(max(0, j - longest), j - 2):
            cost = _word_cost(value[i:j], known)
            if cost is not None:
                spans[j].append((i, cost))
        start = NEXT_SEGMENT if j > 1 else 0.0
        brute[j] = min(brute[j - 1], best[j - 1] + start) + BRUTE_COST
        best[j] = min([brute[j], *(best[i] + cost + (NEXT_SEGMENT if i else 0.0) for i, cost in spans[j])])
    return best[n]


def find_spans(text: str, known: dict[str, int], least: float, shortest: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
        for m in CONTEXT.finditer(text):
            if len(m[1]) >= shortest and guess_cost(m[1], known) >= least:
                found.append(("guess", *m.span(1)))
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: str | list[str] = WORDS,
    least: float = 8.0, shortest: int = 6,
) -> DataFrame:
    """id and spans (kind, start, end; code points, end exclusive) per row of ``docs``, whole texts.

    Kinds: ``assign`` (a credential's name, a sign, a value of eight or more), ``access`` (key ids),
    ``hex`` (32 or more), ``guess``: the value after a credential's name if it has ``shortest`` or more
    characters and its cheapest segmentation costs at least 10 ** ``least`` guesses; the word of a scheme
    (Bearer, Basic, ...) before it is skipped. A character costs ten guesses at most, so values of fewer than
    ``least`` characters never count: eight is the true bound unless ``least`` is lowered.

    Null and empty texts have no spans. Repeated rows give repeated rows, null ids stay null.
    """
    known = ranks(words)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def scan(texts: pa.StringArray) -> list:
        found = (find_spans(t, known, least, shortest) for t in texts.to_pylist())
        return [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]]

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return map_texts(rows, "_text", scan, [T.StructField("spans", T.ArrayType(span))])


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        id_col, of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), of("guess").alias("n_guess"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
