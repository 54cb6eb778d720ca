"""A quality score as a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import SpanHashes, joined_hashes, map_texts, mixed, text_bytes, words
from tidemark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATISTICS = [
    "words", "word_length", "longest_word", "upper", "digits", "marks", "commas", "white", "beyond_ascii", "vowels",
    "upper_words", "marked_words", "closing_words", "digit_words", "distinct_words", "distinct_triples", "lines", "line_words",
    "distinct_lines", "opening_capitals",
]
TRAIN_ROWS = 200_000
TREES, DEPTH = 16, 3
PENALTY = 0.0005


def _classes() -> np.ndarray:
    """One column per class of bytes: upper, digits, marks, commas and stops, white space, beyond ASCII, vowels."""
    table = np.zeros((256, 7))
    table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], 0] = 1
    table[[ord(c) for c in "0123456789"], 1] = 1
    table[[ord(c) for c in "!#$%&*+/<=>@[]^_`{|}~\\"], 2] = 1
    table[[ord(c) for c in ".,;:"], 3] = 1
    table[[0x20, *range(0x09, 0x0E)], 4] = 1
    table[128:, 5] = 1
    table[[ord(c) for c in "aeiouAEIOU"], 6] = 1
    return table


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes per row."""
    _, at = np.unique(mixed(hashes ^ mixed(rows.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(rows[at], minlength=n)


def statistics(texts: pa.StringArray) -> np.ndarray:
    """A row of STATISTICS per text; all 0 for texts without words. Ratios are of bytes, words or lines."""
    n = len(texts)
    raw, offsets = text_bytes(texts)
    out = np.zeros((n, len(STATISTICS)))
    starts, ends, row = words(raw, offsets)
    if not len(starts):
        return out
    counts = np.zeros((n, 256))
    for i in range(n):
        counts[i] = np.bincount(raw[offsets[i] : offsets[i + 1]], minlength=256)
    size = np.maximum(np.diff(offsets), 1)
    kinds = _classes()
    total = np.bincount(row, minlength=n)
    many = np.maximum(total, 1)
    length = ends - starts
    spans = SpanHashes(raw)
    word = spans.of(starts, ends)
    shares = counts @ kinds / size[:, None]
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    of = lambda chosen: np.bincount(row, weights=chosen, minlength=n) / many
    last, first = raw[ends - 1], raw[starts]
    lower = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122), dtype=np.int64)])
    upper = np.concatenate([[0], np.cumsum(kinds[raw, 0] > 0, dtype=np.int64)])
    digit = np.concatenate([[0], np.cumsum(kinds[raw, 1] > 0, dtype=np.int64)])
    inside = lambda sums: sums[ends] - sums[starts]
    firsts = np.cumsum(total) - total
    triple = np.flatnonzero(np.arange(len(row)) - firsts[row] + 3 <= total[row])
    triples = np.bincount(row[triple], minlength=n)
    ends_line = raw == 10
    ends_line[offsets[1:-1][offsets[1:-1] > 0] - 1] = True
    stops = np.append(np.flatnonzero(ends_line[:-1]) + 1, len(raw))
    begins = np.concatenate([[0], stops[:-1]])
    line_row = np.searchsorted(offsets, begins, side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    columns = [
        np.log1p(total), np.bincount(row, weights=length, minlength=n) / many, np.log1p(longest),
        shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3], shares[:, 4], shares[:, 5], shares[:, 6],
        of((inside(upper) > 1) & (inside(lower) == 0)), of(kinds[last, 2] > 0), of(np.isin(last, [33, 46, 63])), of(inside(digit) > 0),
        _distinct(row, word, n) / many, _distinct(row[triple], joined_hashes(word, triple, 3), n) / np.maximum(triples, 1),
        np.log1p(lines), total / np.maximum(lines, 1), _distinct(line_row, spans.of(begins, stops), n) / np.maximum(lines, 1),
        of((first >= 65) & (first <= 90)),
    ]
    out[:] = np.column_stack(columns)
    out[total == 0] = 0
    return out


def with_statistics(df: DataFrame, text_column: str, name: str = "stats") -> DataFrame:
    """``df`` with its text column replaced by the array of STATISTICS; null texts count as empty."""
    return map_texts(df, text_column, lambda texts: [list(statistics(texts))], [T.StructField(name, T.ArrayType(T.DoubleType()))])


Rule = tuple[tuple[int, str, float], ...]


def tree_rules(description: str) -> list[Rule]:
    """Every path from the root of a tree, as printed, to one of its nodes: conditions (statistic, sign, bound)."""
    path: list[tuple[int, str, float]] = []
    rules = []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if m:
            path = path[: len(m[1]) - 2] if len(m[1]) >= 2 else []
            path.append((int(m[2]), m[3], float(m[4])))
            rules.append(tuple(path))
    return rules


def simplified(rule: Rule) -> Rule:
    """The tightest bound per statistic and direction, in a fixed order."""
    tight: dict[tuple[int, str], float] = {}
    for stat, sign, bound in rule:
        held = tight.get((stat, sign), bound)
        tight[stat, sign] = min(held, bound) if sign == "<=" else max(held, bound)
    return tuple((stat, sign, bound) for (stat, sign), bound in sorted(tight.items()))


def holds(rule: Rule, stats: str = "stats") -> Column:
    """A rule as a column expression: 1 where all of its conditions hold."""
    test = F.lit(True)
    for stat, sign, bound in rule:
        value = F.col(stats)[stat]
        test = test & (value <= bound if sign == "<=" else value > bound)
    return test.cast("double")


class RuleEnsemble:
    """Weighted rules: the score is the logistic function of the intercept and the weights of the rules that hold."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.lit(weight) * holds(rule, stats)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        named = lambda rule: " and ".join(f"{STATISTICS[s]} {sign} {bound:.4g}" for s, sign, bound in rule)
        return [f"{weight:+.3f} {named(rule)}" for rule, weight in sorted(self.rules, key=lambda r: -abs(r[1]))]


def fit_rules(
    labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7,
) -> RuleEnsemble:
    """Fits on ``labelled`` (key, stats, label 0 or 1), a written table.

    At most about ``train_rows`` rows are used, chosen by the hash of their key. Shallow trees propose rules,
    one per path; a logistic regression with a lasso penalty weighs them and sets most weights to 0. Without
    both labels the score is the share of label 1, or one half without any rows.
    """
    rows, ones = labelled.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not rows or not ones or ones == rows:
        share = (float(ones or 0) + 0.5) / (rows + 1)
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    bound = min(1.0, train_rows / rows)
    chosen = labelled.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(bound * 1_000_000)))
    train = cut_lineage(chosen.select(array_to_vector("stats").alias("x"), "stats", F.col("label").cast("double").alias("label")))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed,
    ).fit(train)
    rules = sorted({simplified(rule) for tree in forest.trees for rule in tree_rules(tree.toDebugString)})
    if not rules:
        return RuleEnsemble([], float(np.log(ones / (rows - ones))))
    marked = train.select(array_to_vector(F.array(*[holds(rule) for rule in rules])).alias("rules"), "label")
    fitted = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(marked)
    weights = fitted.coefficients.toArray()
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], float(fitted.intercept))


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learnt from: crc32 of the id as text leaves 2 when divided by 4; null ids are not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _train(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> RuleEnsemble:
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("key"), F.col(label_col).alias("label"))
    rows = stats.filter(~held_out(F.col("key"))).join(known, "key").select("key", "stats", "label")
    return fit_rules(cut_lineage(rows))


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``; only the text's statistics enter the score.

    Learns from the labelled rows that are not held out (null and other labels are ignored, repeated ones
    count as often). Null and empty texts have statistics of 0 and get a score too. Repeated rows give
    repeated rows; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("_text"))
    stats = cut_lineage(with_statistics(rows, "_text"))
    score = _train(stats, labels, id_col, label_col).score()
    return stats.select(F.col("key").alias(id_col), held_out(F.col("key")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    known = labels.select(id_col).distinct()
    learn = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("_text")).join(known.withColumnRenamed(id_col, "key"), "key", "left_semi")
    model = _train(cut_lineage(with_statistics(learn, "_text")), labels, id_col, label_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("_text"))
    return with_statistics(rows, "_text").filter(model.score() >= threshold).select("row.*")
