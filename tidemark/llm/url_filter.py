"""Judging urls: host and path rules first, boosted trees over lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import lookup_join
from tidemark.session import cut_lineage

TRAIN_ROWS = 200_000
FOLDS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the rest. The host follows the first ``://`` and ends at ``/``, ``?``, ``#``; ASCII letters are lowered.

    Null urls and urls without ``://`` have empty parts.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2), part(3)


def _rate(counted: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, counted / F.length(text)).otherwise(F.lit(0.0))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character counts; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0))


def lexical(url: Column, host: Column, path: Column, rest: Column) -> list[Column]:
    """Length, depth, digits, marks, parameters and entropy of a url and its parts."""
    return [
        F.log1p(F.length(url).cast("double")), F.length(host).cast("double"), F.length(path).cast("double"),
        _without(path, "/").cast("double"), _without(host, ".").cast("double"), _without(host, "-").cast("double"),
        _rate(_without(url, "0123456789"), url), _rate(_without(host, "0123456789"), host), _rate(_without(url, "-_%~@!$*"), url),
        F.when(rest.startswith("?"), _without(F.split(rest, "#")[0], "&") + 1).otherwise(0).cast("double"), _without(rest, "=").cast("double"),
        rest.contains("#").cast("double"), entropy(host), entropy(path), url.startswith("https").cast("double"),
    ]


def rule_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """seq, rule and verdict of the longest rule that fits each page (seq, host, path); pages no rule fits are left out.

    A rule (host, path, verdict) fits its host and all subdomains if the page's path starts with its path.
    Each page looks up the suffixes of its host, so a list of any length costs one equi-join. Equal rules with
    different verdicts block.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lookups = pages.filter("host <> ''").select("seq", "path", F.explode(suffixes).alias("rule_host"))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    by_host = known.groupBy("rule_host").agg(F.collect_set(F.struct("rule_path", "rule_verdict")).alias("found"))
    hits = lookup_join(lookups, by_host, ["rule_host"], salt_on="seq").select("seq", "path", "rule_host", F.explode("found").alias("r"))
    fits = hits.filter(F.col("path").startswith(F.col("r.rule_path")))
    rule = F.concat("rule_host", "r.rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.col("r.rule_verdict").alias("verdict"), rule.alias("rule")))
    return fits.groupBy("seq").agg(best.alias("b")).select("seq", "b.rule", "b.verdict")


def _suffix_statistics(pages: DataFrame) -> DataFrame:
    """Per host suffix its pages, and the blocked and labelled ones among them, also by fold."""
    of = lambda fold, name: F.sum(F.when(F.col("fold") == fold, F.col(name))).alias(f"{name}{fold}")
    known = pages.withColumns({"bad": F.coalesce("label", F.lit(0.0)), "known": F.col("label").isNotNull().cast("double")})
    folds = [of(fold, name) for fold in range(FOLDS) for name in ("bad", "known")]
    return known.groupBy("suffix").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("often"), F.sum("bad").alias("bad"), F.sum("known").alias("known"), *folds)


def _share(fold: Column | None) -> Column:
    """The smoothed share of blocked pages of a suffix; for a row to learn from, without the rows of its own fold."""
    own = lambda name: F.lit(0.0) if fold is None else F.coalesce(*[F.when(fold == i, F.col(f"{name}{i}")) for i in range(FOLDS)], F.lit(0.0))
    return (F.coalesce("bad", F.lit(0.0)) - own("bad") + 1.0) / (F.coalesce("known", F.lit(0.0)) - own("known") + 2.0)


def judge_urls(
    pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, rounds: int = 10, depth: int = 3,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict and the trees' chance of blocking (``blocked``) per row of ``pages``.

    The longest rule that fits decides. Where none fits, the verdict comes from boosted trees over lexical
    features and statistics of the host's last two labels (a row to learn from does not count in its own). They learn from ``labelled`` (url, label 1 for
    block), by default from the pages that a rule decides, at most about ``train_rows`` of them, chosen by
    the hash of the url. Without labels of both kinds the trees allow, or block if that is all there is.

    Null urls and urls without a host have empty parts, fit no rule and are judged like others. Repeated rows
    are judged alike; an empty table gives no rows. Other columns are ignored.
    """
    host, path, rest = url_parts(F.col("url"))
    rows = cut_lineage(pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.monotonically_increasing_id().alias("seq")))
    parts = rows.withColumns({"host": host, "path": path, "rest": rest})
    found = rule_verdicts(parts.select("seq", "host", "path"), rules)
    judged = parts.join(found, "seq", "left")
    suffix = F.substring_index("host", ".", -2)
    fold = F.pmod(F.xxhash64("url", F.lit(FOLDS)), F.lit(FOLDS))
    values = F.array(*lexical(F.col("url"), F.col("host"), F.col("path"), F.col("rest")))
    judged = judged.withColumns({"suffix": suffix, "x": values, "label": (F.col("verdict") == "block").cast("double"), "fold": fold}).drop("rest")
    judged = cut_lineage(judged)
    if labelled is None:
        sample = judged.filter("label IS NOT NULL").select("url", "suffix", "x", "label", "fold")
        seen = judged.select("suffix", "label", "fold")
    else:
        own = labelled.select(F.coalesce(F.col("url"), F.lit("")).alias("url"), F.col("label").cast("double").alias("label"))
        own = own.withColumns({"host": host, "path": path, "rest": rest})
        sample = cut_lineage(own.select("url", suffix.alias("suffix"), values.alias("x"), "label", fold.alias("fold")))
        seen = judged.select("suffix", F.lit(None).cast("double").alias("label"), "fold").unionByName(sample.select("suffix", "label", "fold"))
    statistics = cut_lineage(_suffix_statistics(seen))
    features = lambda own: array_to_vector(F.concat("x", F.array(F.coalesce("often", F.lit(0.0)), _share(own)))).alias("features")
    total, bad = sample.agg(F.count("label"), F.sum("label")).first()
    if not total or not bad or bad == total:
        scored = judged.withColumn("blocked", F.lit(1.0 if total and bad == total else 0.0))
    else:
        bound = int(min(1.0, train_rows / total) * 1_000_000)
        train = sample.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < bound)
        train = cut_lineage(lookup_join(train, statistics, ["suffix"], salt_on="url").select(features(F.col("fold")), "label"))
        model = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(train)
        joined = lookup_join(judged, statistics, ["suffix"], "left", salt_on="seq")
        scored = model.transform(joined.select("id", "host", "path", "rule", "verdict", features(None)))
        scored = scored.withColumn("blocked", vector_to_array("probability")[1])
    verdict = F.coalesce("verdict", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "blocked")
