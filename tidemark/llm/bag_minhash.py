"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash, banding, exact verification."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import GOLDEN, SpanHashes, joined_hashes, map_texts, mixed, spread, text_bytes, words
from tidemark.llm.components import components, merged
from tidemark.llm.digest_tree import keep_rows, normalised, tree_merge
from tidemark.operators.joins import lookup_join
from tidemark.session import cut_lineage, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_BAND = 4
COMMON = 2  # bands that a pair has to share, whatever the size of its buckets
BANDS = 30  # so that pairs at 0.8 share two bands but for a chance of 3e-6
SLACK = 4.0  # a first bound on time leaves a register empty with a chance of about exp(-SLACK) each
SKETCH = 1024  # registers, of two bits each: what passes at 0.8 is nearer than 0.71
PIVOT_ROUNDS = 2
PAIRS_PER_ROW = 32  # a comparison of two sketches is a few dozen machine operations


def shingle_counts(texts: pa.StringArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle of ``width`` words, ordered by row.

    A text of fewer words is one shingle of them all; a text without words has none.
    """
    raw, offsets = text_bytes(texts)
    starts, ends, row = words(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = SpanHashes(raw).of(starts, ends)
    per_row = np.bincount(row, minlength=len(texts))
    first_word = np.cumsum(per_row) - per_row
    place = np.arange(len(word)) - first_word[row]
    full = np.flatnonzero(place + width <= per_row[row])
    hashes, owner = [joined_hashes(word, full, width)], [row[full]]
    for n in range(1, width):
        short = np.flatnonzero(per_row == n)
        hashes.append(joined_hashes(word, first_word[short], n))
        owner.append(short)
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """``registers`` minima per row of the points that the row's shingles own; equal minima mean the same point.

    Weights are cut at the whole numbers into dyadic blocks (0,1], (1,2], (2,4], (4,8], ... Each (shingle,
    block) owns a Poisson process in time whose rate is the block's width; every point has a register and,
    inside a wider block, a level. A shingle of count w contributes the points whose level is at most w, so
    two rows share exactly the points below the smaller count, and the chance that a register agrees is the
    weighted Jaccard similarity. Points are made in order of time and only up to the time by which all
    registers of the row are very likely taken; rows that still have an empty one go on to twice that time.
    """
    out = np.full((n_rows, registers), np.inf)
    if not len(owner):
        return out
    weight = np.bincount(owner, weights=counts, minlength=n_rows)
    pieces = [(owner, hashes, np.ones(len(owner)), np.zeros(len(owner)), counts)]
    block, low = 1, 1
    while True:
        more = np.flatnonzero(counts > low)
        if not len(more):
            break
        seed = mixed(hashes[more] + spread(block))
        pieces.append((owner[more], seed, np.full(len(more), float(low)), np.full(len(more), float(low)), counts[more]))
        block, low = block + 1, low * 2
    row, seed, rate, base, count = (np.concatenate(p) for p in zip(*pieces, strict=True))
    limit = np.where(weight > 0, registers * (np.log(registers) + SLACK) / np.maximum(weight, 1), 0.0)
    time, step = np.zeros(len(row)), np.zeros(len(row), dtype=np.uint64)
    flat = out.ravel()
    pending = np.arange(len(row))
    while len(pending):
        waiting = []
        while len(pending):
            random = mixed(seed[pending] + (step[pending] + np.uint64(1)) * GOLDEN)
            more = mixed(random ^ GOLDEN)
            gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 1.0) / (1 << 53)) / rate[pending]
            due = time[pending] + gap
            late = due >= limit[row[pending]]
            waiting.append(pending[late])
            now = ~late
            pending, due, more = pending[now], due[now], more[now]
            time[pending], step[pending] = due, step[pending] + np.uint64(1)
            level = base[pending] + (more >> np.uint64(32)).astype(np.float64) / (1 << 32) * rate[pending]
            hit = (base[pending] == 0) | (level < count[pending])
            register = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, row[pending[hit]] * registers + register[hit], due[hit])
        empty = np.isinf(out).any(axis=1) & (weight > 0)
        limit = np.where(empty, limit * 2, limit)
        waiting = np.concatenate(waiting)
        pending = waiting[empty[row[waiting]]]
    return out


def shingle_sets(texts: pa.StringArray, width: int) -> list[np.ndarray]:
    """Per text the hashes of (shingle, 1), ..., (shingle, count): as sets, they overlap as the multisets do."""
    owner, hashes, counts = shingle_counts(texts, width)
    copies = np.repeat(np.arange(len(owner)), counts)
    nth = np.arange(len(copies)) - np.repeat(np.cumsum(counts) - counts, counts)
    values = mixed(hashes[copies] + nth.astype(np.uint64) * GOLDEN).view(np.int64)
    ends = np.cumsum(np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64))
    return np.split(values, ends[:-1])


def missed(similarity: float, bands: int, common: int = 1) -> float:
    """Chance that two texts of this similarity share fewer than ``common`` of ``bands`` bands."""
    same = similarity**ROWS_PER_BAND
    return sum(math.comb(bands, i) * same**i * (1 - same) ** (bands - i) for i in range(common))


def _signed(df: DataFrame, width: int, bands: int) -> DataFrame:
    """Adds fp1 and fp2 (sums over the multiset, equal for equal multisets), weight and band keys."""
    registers = bands * ROWS_PER_BAND

    def sign(texts: pa.StringArray) -> list:
        n = len(texts)
        owner, hashes, counts = shingle_counts(texts, width)
        weighted = mixed(hashes + counts.astype(np.uint64) * GOLDEN)
        sums = []
        for part in (weighted, mixed(weighted ^ GOLDEN)):
            total = np.zeros(n, dtype=np.uint64)
            np.add.at(total, owner, part)
            sums.append(total.view(np.int64))
        # rounded, so that the last bit of a logarithm on another machine does not matter
        times = signatures(owner, hashes, counts, n, registers).astype(np.float32)
        codes = mixed(times.view(np.uint32).astype(np.uint64) + GOLDEN)
        first = (np.arange(n)[:, None] * registers + np.arange(bands) * ROWS_PER_BAND).ravel()
        keys = mixed(joined_hashes(codes.ravel(), first, ROWS_PER_BAND).reshape(n, bands) + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)
        weight = np.bincount(owner, weights=counts, minlength=n).astype(np.int64)
        return [sums[0], sums[1], weight, list(keys.view(np.int64))]

    return map_texts(df, "_text", sign, [
        T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("weight", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])


def sketches(texts: pa.StringArray, width: int) -> list[np.ndarray]:
    """Two bits of each of SKETCH registers per text: longs of 64 first bits, and then as many of the second bits."""
    n = len(texts)
    times = signatures(*shingle_counts(texts, width), n, SKETCH).astype(np.float32)
    codes = mixed(times.view(np.uint32).astype(np.uint64) + GOLDEN).reshape(n, SKETCH // 64, 64)
    place = np.arange(64, dtype=np.uint64)
    planes = [np.bitwise_or.reduce(((codes >> np.uint64(bit)) & np.uint64(1)) << place, axis=2) for bit in (0, 1)]
    return list(np.concatenate(planes, axis=1).view(np.int64))


def _drawn(sketch: str) -> list[Column]:
    return [F.col(sketch)[i] for i in range(SKETCH // 32)]


def _alike(a: list[Column], b: list[Column], similarity: float) -> Column:
    """By their sketches a pair may reach ``similarity``: 5.5 deviations away it surely does not.

    Two bits of a register agree with a chance of s + (1 - s) / 4 at similarity s.
    """
    agree = similarity + (1 - similarity) / 4
    most = math.ceil(SKETCH * (1 - agree) + 5.5 * math.sqrt(SKETCH * agree * (1 - agree)))
    differs = [x.bitwiseXOR(y) for x, y in zip(a, b, strict=True)]
    half = len(differs) // 2
    return sum((F.bit_count(x.bitwiseOR(y)) for x, y in zip(differs[:half], differs[half:], strict=True)), F.lit(0)) <= most


def _weights_fit(similarity: float) -> Column:
    return F.least("a.weight", "b.weight") >= F.greatest("a.weight", "b.weight") * F.lit(similarity)


def _first_shared() -> Column:
    """The pair meets in the first band whose key both have; later ones would only find it again.

    Of an earlier bucket that both stood in, one of them left it as its pivot, having met the other; or all its members are
    connected; or it was cut, and both stand together in the piece that this band names as well.
    """
    return ~F.arrays_overlap("a.earlier", "b.earlier")


def _shared_enough(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) >= COMMON


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough, exactly. Only the sets of these pairs move."""
    def of(side: str) -> DataFrame:
        wanted = pairs.select(F.col(side).alias("node")).distinct()
        return lookup_join(sets, wanted, ["node"]).select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))

    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _named(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with their node's label: the node itself while it has no link. A node meets its label once, not per entry."""
    if labels is None:
        return live.withColumn("label", F.col("node"))
    held = live.groupBy("node", "weight").agg(F.collect_list(F.struct("bucket", "band")).alias("held")).join(labels, "node", "left")
    return held.select("node", "weight", F.coalesce("label", "node").alias("label"), F.explode("held").alias("at")).select("node", "weight", "label", "at.*")


def _open_buckets(named: DataFrame) -> DataFrame:
    """Buckets whose members are not all connected: their members (n) and the pairs that are not."""
    groups = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = groups.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return open_.filter("n * n > same").withColumn("pairs", (F.col("n") * F.col("n") - F.col("same")) / 2)


def _cut(named: DataFrame, open_: DataFrame, nodes: DataFrame, left: float) -> DataFrame | None:
    """Entries with each large bucket replaced by its intersections with its members' other buckets; None if that is no gain.

    A pair that shares k bands meets in up to k * (k - 1) / 2 pieces. Where most pairs share many bands, as between the near
    copies of one text, the pieces hold more pairs than the ``left`` ones of the whole buckets.
    """
    heavy = F.col("pairs") > PAIRS_PER_ROW * F.col("n")
    split = named.join(open_.filter(heavy).select("bucket"), "bucket").join(nodes.select("node", F.explode("bands").alias("other")), "node")
    split = split.filter("other <> bucket").withColumn("bucket", F.xxhash64(F.least("bucket", "other"), F.greatest("bucket", "other")))
    split = split.drop("other").withColumn("band", F.lit(None).cast("int")).dropDuplicates(["bucket", "node"])
    rest = named.join(open_.filter(~heavy).select("bucket"), "bucket")
    after = _open_buckets(rest.unionByName(split)).agg(F.sum("pairs")).first()[0] or 0
    if 2 * after > left:
        return None
    crowded = split.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return cut_lineage(rest.unionByName(split.join(crowded, "bucket")).drop("label"))


def _links(nodes: DataFrame, details_of, similarity: float, bands: int) -> DataFrame | None:
    """node and label for every node that has a link, labels equal within a connected group.

    Buckets are compared in rounds. In a round one member of each bucket, the pivot, meets all others that
    it is not yet connected with; then it leaves the bucket. The pivot is the member that shares most buckets with most
    others: the middle of a group of near copies, which links most of it at once. A bucket whose remaining members are all
    connected is finished. When few pairs are left, all that are not connected meet. A pair counts only if it
    shares ``COMMON`` bands, wherever it meets, so buckets that stay large (many texts that share a lot but not
    enough) can be cut by the keys of the other bands first, which loses no pair and adds none; where that gives no fewer
    pairs, the buckets stay whole. Entries hold a node, its
    weight and a bucket; sketches, band keys and sets come to the pairs. A round's tables go once the next one's are written.
    """
    entries = nodes.select("node", "weight", F.posexplode("bands").alias("band", "bucket"))
    crowded = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    live = cut_lineage(entries.join(crowded, "bucket"))
    details = cut_lineage(details_of(live.select("node").distinct()))
    sets, drawn = details.select("node", "set"), details.select("node", "sketch", "short")
    labels, whole_buckets = None, False
    turn = 0
    while True:
        named = _named(live, labels)
        open_ = cut_lineage(_open_buckets(named))
        left, rows = open_.agg(F.sum("pairs"), F.sum("n")).first()
        if not left:
            break
        if turn == PIVOT_ROUNDS and left > PAIRS_PER_ROW * rows:
            turn += 1
            cut = _cut(named, open_, nodes, left)
            if cut is not None:
                release(live)
                live = cut
                continue
            whole_buckets = True
        named = cut_lineage(named.join(open_.select("bucket", F.col("n").alias("size")), "bucket"))
        release(open_)
        release(live)
        last = whole_buckets or left <= PAIRS_PER_ROW * rows or turn > 2 * PIVOT_ROUNDS
        if last:
            earlier = F.when(F.col("band").isNotNull(), F.transform(F.slice("short", 1, F.col("band")), lambda key, i: F.struct(i, key)))
            planes = [f"plane_{i}" for i in range(SKETCH // 32)]
            whole = named.join(drawn, "node").withColumn("earlier", earlier)
            whole = cut_lineage(whole.select("node", "weight", "label", "bucket", "short", "earlier", *(c.alias(p) for c, p in zip(_drawn("sketch"), planes, strict=True))))
            a, b = whole.alias("a"), whole.alias("b")
            alike = _alike([F.col(f"a.{p}") for p in planes], [F.col(f"b.{p}") for p in planes], similarity)
            met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
                         & _weights_fit(similarity) & alike & F.coalesce(_first_shared(), F.lit(True)) & _shared_enough("a.short", "b.short"))
            met = cut_lineage(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
            release(whole)
        else:
            company = named.groupBy("node").agg(F.sum("size").alias("company"))
            pivot = F.max_by(F.struct("node", "weight", "label"), F.struct("company", F.xxhash64("node"), "node"))
            pivots = cut_lineage(named.join(company, "node").groupBy("bucket").agg(pivot.alias("p")).select("bucket", "p.*"))
            a, b = named.alias("a"), pivots.alias("b")
            met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.label") != F.col("b.label")) & _weights_fit(similarity))
            met = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
            for side in ("a", "b"):
                met = met.join(drawn.select(F.col("node").alias(side), F.struct("sketch", "short").alias(f"of_{side}")), side)
            met = met.filter(_alike(_drawn("of_a.sketch"), _drawn("of_b.sketch"), similarity) & _shared_enough("of_a.short", "of_b.short"))
            met = cut_lineage(met.select("a", "b"))
        found = cut_lineage(_verified(met, sets, similarity))
        if not found.isEmpty():
            before, labels = labels, components(found) if labels is None else merged(labels, found)
            if before is not None:
                release(before)
        release(met)
        release(found)
        if last:
            release(named)
            break
        live = cut_lineage(named.drop("label", "size").join(pivots.select("bucket", "node"), ["bucket", "node"], "left_anti"))
        release(named)
        release(pivots)
        turn += 1
    release(details)
    return labels


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, group_id (the smallest id of its group), group_size, kept, text_sha256.

    Two texts are linked when the weighted Jaccard similarity of their word shingles (``width`` words, each
    with its count; words are runs other than ASCII white space) is at least ``similarity``; groups are what
    links connect. Texts with the same shingle counts are one class from the start, of which one goes on.
    Candidates share two bands, each of four of the signature's registers: with 30 bands a pair at 0.8 is missed
    with a chance of 3e-6 (``missed``), nearer ones less. That holds for every pair: neither the number of rows nor
    the size of a bucket has a part in it. Every link is verified on the whole multisets.

    A text of fewer than ``width`` words is one shingle; texts without words (also null) are alone. One row
    of a group is kept: the smallest id, null ids last, of repeated rows one. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("seq")).alias("me"),
        F.sha2(normalised(text), 256).alias("text_sha256"), F.xxhash64(text).alias("name"), F.octet_length(text).alias("length"), text.alias("_text"),
    )
    members = cut_lineage(_signed(rows, width, bands))
    alone = F.when(F.col("weight") == 0, F.col("me.seq")).otherwise(F.col("fp2"))
    classes = cut_lineage(tree_merge(members.withColumn("fp2", alone), ["fp1", "fp2", "weight"], "me"))
    release(members)
    first = classes.filter((F.col("me.seq") == F.col("first.seq")) & (F.col("weight") > 0)).withColumn("node", F.col("me.seq"))

    def details_of(wanted: DataFrame) -> DataFrame:
        names = cut_lineage(wanted.join(first.select("node", "name", "length"), "node"))
        source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        source = source.withColumns({"name": F.xxhash64("_text"), "length": F.octet_length("_text")})
        found = lookup_join(source, names.dropDuplicates(["name", "length"]), ["name", "length"]).dropDuplicates(["node"])
        longs = T.ArrayType(T.LongType())
        short = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int"))
        found = found.select("node", "_text").join(first.select("node", short.alias("short")), "node")
        return map_texts(found, "_text", lambda texts: [shingle_sets(texts, width), sketches(texts, width)],
                         [T.StructField("set", longs), T.StructField("sketch", longs)])

    labels = _links(first.select("node", "weight", "bands"), details_of, similarity, bands)
    whole = classes.select("me", "first", "group_size", "text_sha256")
    if labels is not None:
        linked = first.select("node", "first", "group_size").join(labels, "node")
        groups = linked.groupBy("label").agg(F.min("first").alias("keep"), F.sum("group_size").alias("size"))
        linked = cut_lineage(linked.select("node", "label").join(groups, "label").drop("label"))
        whole = lookup_join(whole.withColumn("node", F.col("first.seq")).withColumn("seq", F.col("me.seq")), linked, ["node"], "left", salt_on="seq")
        whole = whole.withColumns({"first": F.coalesce("keep", "first"), "group_size": F.coalesce("size", "group_size")})
    return whole.select(
        F.col("me.id").alias(id_col), F.col("first.id").alias("group_id"), "group_size",
        (F.col("me.seq") == F.col("first.seq")).alias("kept"), "text_sha256",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One document of every group, with all columns of ``docs``."""
    decided = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept")
    return keep_rows(docs, decided.select(F.col(id_col).alias("id"), "text_sha256"), id_col, text_col)
