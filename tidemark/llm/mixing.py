"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.digest_tree import normalised
from tidemark.operators.joins import lookup_join
from tidemark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
FINE, COARSE = 1 << 10, 1 << 20
GOLDEN = (math.sqrt(5) - 1) / 2
# The fraction of 2^20 times the golden ratio: with it, i = 2^20 * high + low keeps 32 bits of a point exact.
GOLDEN_HIGH = float((Decimal(5).sqrt() - 1) / 2 * COARSE % 1)


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running_total(rows: DataFrame, part: str, place: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the same ``part``, exclusive.

    ``place`` is a whole number that rises with the order; rows are summed by its high bits, by its middle
    bits, and within those, so that no task ever holds the rows of a whole part.
    """
    high, middle = F.floor(F.col(place) / COARSE), F.floor(F.col(place) / FINE)
    rows = rows.withColumns({"_high": high, "_middle": middle})
    before = lambda keys, by: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middles = rows.groupBy(part, "_high", "_middle").agg(F.sum(value).alias("_sum"))
    highs = middles.groupBy(part, "_high").agg(F.sum("_sum").alias("_sum"))
    highs = highs.select(part, "_high", before([part], ["_high"]).alias("_h"))
    middles = middles.select(part, "_high", "_middle", before([part, "_high"], ["_middle"]).alias("_m"))
    own = rows.withColumn("_sum", F.col(value)).withColumn("_r", before([part, "_high", "_middle"], order))
    joined = own.join(middles, [part, "_high", "_middle"]).join(highs, [part, "_high"])
    return joined.withColumn(name, F.col("_h") + F.col("_m") + F.col("_r")).drop("_high", "_middle", "_sum", "_r", "_h", "_m")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds sid (place by code point, null last) and target to one row per source (source, source_size).

    Weights repeat along the order. Targets add up to ``share`` of all sizes, are in proportion to the
    weights, and stop at ``most`` times a source's size, what is over going to the others by weight. That
    ends at target = min(most * size, level * weight): with the sources ordered by most * size / weight,
    the level follows from how many of them are full.
    """
    everywhere = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(most))})
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    filled = ranked.withColumns({
        "full": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "whole": F.sum("source_size").over(everywhere) * F.lit(float(share)),
    })
    # the level if all earlier sources are full and this one is not; the right one is the first that fits
    level = (F.col("whole") - F.col("full")) / F.col("open")
    filled = filled.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    found = F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(found * F.col("w"), F.col("cap")))
    return filled.select("sid", "source", "source_size", target.alias("target"))


def schedule(sources: DataFrame) -> DataFrame:
    """sid, slot, rank: the golden-ratio points, each in the interval of its source's share of the slots.

    ``sources`` has sid and n_slots (real). Point i is the fraction of i times the golden ratio. Points find
    their interval through a grid of cells, each of which knows the few sources that reach into it.
    """
    spark = sources.sparkSession
    total, count = sources.agg(F.sum("n_slots"), F.count(F.lit(1))).first()
    slots, cells = round(total or 0), max(1, 4 * count)
    so_far = F.coalesce(F.sum("n_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    edges = sources.filter("n_slots > 0").withColumn("low", so_far / F.lit(float(total or 1)))
    edges = edges.withColumn("high", F.lead("low", 1, 1.0).over(Window.orderBy("sid")))
    cell = lambda u: F.least(F.floor(u * cells), F.lit(cells - 1))
    reach = edges.select("sid", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    i = F.col("slot")
    high, low = F.floor(i / COARSE), i % COARSE
    point = high * F.lit(GOLDEN_HIGH) + low * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", point - F.floor(point)).withColumn("cell", cell(F.col("u")))
    hit = points.join(reach, "cell").filter("u >= low AND u < high").select("sid", "slot", F.lit(1).alias("one"))
    return running_total(hit, "sid", "slot", ["slot"], "one", "rank").select("sid", "slot", "rank")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0,
    blocks: int = 4096, block_words: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words drawn), text_sha256.

    The documents of a source, in a shuffled order that ids, texts and ``seed`` fix, form one stream of words,
    cut into equal blocks (``block_words`` words, fewer where a source would have under ``blocks`` blocks).
    The schedule deals slots to sources; a source's slot number r takes its block r modulo their number.
    A block is drawn at most ``most`` times. A document's ``taken`` adds up its parts of the drawn blocks.

    Null texts are empty and null sources a source of their own, last in order. Empty documents take 0, so do
    all if there are no words. Repeated rows are documents of their own. An empty table gives no rows.
    """
    text = F.col(text_col)
    facts = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.sha2(normalised(text), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("seq"),
    ).withColumn("place", F.pmod(F.xxhash64("id", "text_sha256", F.lit(seed)), F.lit(1 << 30))).withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    sizes = facts.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    per_block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / blocks))).cast("long")
    sources = targets(sizes, list(weights), share, most).withColumn("block", per_block)
    sources = cut_lineage(sources.withColumns({
        "n_slots": F.col("target") / F.col("block"), "n_blocks": F.ceil(F.col("source_size") / F.col("block")),
        "source_key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
    }))
    dim = sources.drop("source", "n_slots")
    rows = lookup_join(facts, dim, ["source_key"], salt_on="seq")
    rows = running_total(rows, "sid", "place", ["place", "id", "text_sha256", "seq"], "size", "start")
    rows = cut_lineage(rows)

    slots = lookup_join(schedule(sources), sources.select("sid", "n_blocks"), ["sid"], salt_on="slot")
    drawn = slots.filter(F.col("rank") < F.col("n_blocks") * most)
    draws = drawn.groupBy("sid", (F.col("rank") % F.col("n_blocks")).alias("number")).agg(F.count(F.lit(1)).alias("draws"))
    end = F.col("start") + F.col("size")
    parts = rows.filter("size > 0").select("seq", "sid", "start", end.alias("end"), "block", F.explode(
        F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block")))).alias("number"))
    width = F.least(F.col("end"), (F.col("number") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("number") * F.col("block"))
    taken = parts.join(draws, ["sid", "number"]).groupBy("seq").agg(F.sum(width * F.col("draws")).alias("taken"))
    return rows.join(taken, "seq", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "text_sha256",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options: object) -> DataFrame:
    """The mix itself: every document as often as it was drawn, with all columns of ``docs``.

    A document of which only a part was drawn beyond whole copies adds a row with that many of its first
    words, joined by single spaces; ``length_col``, where there is one, then counts that text.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    drawn = mix(docs, id_col=id_col, text_col=text_col, **options).filter("taken > 0")
    drawn = drawn.groupBy(name(F.col(id_col)).alias("_id"), F.col("text_sha256").alias("_sha"), F.col("size").alias("_size")).agg(F.sum("taken").alias("_taken"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name(F.col(id_col)).alias("_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("_sha"),
    )
    found = rows.join(drawn, ["_id", "_sha"]).dropDuplicates(["_id", "_sha"])
    copies = found.withColumn("_left", F.explode(F.sequence(F.col("_taken"), F.lit(1), -F.col("_size"))))
    words = F.filter(F.split(F.col(f"row.`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, 1, F.col("_left").cast("int")), " ")
    text = F.when(F.col("_left") < F.col("_size"), part).otherwise(F.col(f"row.`{text_col}`"))
    copies = copies.withColumn("_text", text)
    values = {text_col: F.col("_text")}
    if length_col in docs.columns:
        values[length_col] = F.when(F.col("_left") < F.col("_size"), F.length("_text")).otherwise(F.col(f"row.`{length_col}`"))
    return copies.select(*[values.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
