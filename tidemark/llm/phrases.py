"""Phrases whose words stand together more often than their parts alone would make them."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import batches as texts
from tidemark.llm import phrase_index
from tidemark.llm.batches import BATCH_BYTES, SpanHashes, _split, text_bytes
from tidemark.llm.phrase_index import extensions, packed, packed_text, thinned, unpacked, unpacked_text
from tidemark.operators.joins import lookup_join
from tidemark.session import cut_lineage, release, shared_dir, shuffles_removed
from tidemark.sinks import state

for module in (sys.modules[__name__], phrase_index, texts):
    cloudpickle.register_pickle_by_value(module)

SHARD_WORDS = 1_200_000  # an index of so many words takes some 150 MB while it is used
BUCKET_BYTES = 8 * 1024 * 1024  # of text, per task that sums
UNKNOWN = "und"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"  # a setting of Spark's
TEXT, LIST, RUN, TOTAL, PHRASE = range(5)  # kinds of rows
ROW = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int64()), ("bucket", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("gid", pa.int64()),
    ("head", pa.int64()), ("tail", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()),
])
FIELDS = ("kind int, shard long, bucket int, lang string, phrase string, gid long, head long, tail long, n long,"
          " a binary, b binary, c binary, d binary")
# The characters that end a piece, and those between words.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09]] = True


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ROW)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words (A-Z in lower case), their lengths, the rows they stand in, and whether one begins a piece."""
    raw = np.where((raw >= 65) & (raw <= 90), raw | 0x20, raw).astype(np.uint8)
    breaks = BREAKS[raw]
    solid = ~(breaks | BLANKS[raw])
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < len(raw))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(breaks)[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])
    return raw[solid], ends - starts, rows, fresh


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text bytes, offsets and languages in portions of about BATCH_BYTES; a long text is cut where a piece ends."""
    for part in _split(batch, "text"):
        raw, offsets = text_bytes(part.column("text").fill_null(""))
        langs = np.array(part.column("lang").fill_null(UNKNOWN).to_pylist(), dtype=object)
        if len(langs) > 1 or len(raw) <= BATCH_BYTES:
            yield raw, offsets, langs
            continue
        while len(raw):
            ends = np.flatnonzero(BREAKS[raw[BATCH_BYTES:]])
            cut = BATCH_BYTES + int(ends[0]) + 1 if len(ends) else len(raw)
            yield raw[:cut], np.array([0, min(cut, len(raw))]), langs
            raw = raw[cut:]


def _tokenise(batches: Iterator[pa.RecordBatch], n_buckets: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Shards of word ids with their words: text rows, runs of words with counts per bucket, totals per language."""
    shard, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for raw, offsets, langs in _chunks(batch):
            letters, lengths, rows, fresh = _words(raw, offsets)
            if held and size + len(lengths) > shard_words:
                yield _shard(held, shard, n_buckets)
                shard, held, size = shard + 1, [], 0
            held.append((letters, lengths, langs[rows], fresh))
            size += len(lengths)
    if size:
        yield _shard(held, shard, n_buckets)


def _shard(held: list[tuple], shard: int, n_buckets: int) -> pa.RecordBatch:
    letters, lengths, langs, fresh = (np.concatenate(x) for x in zip(*held, strict=True))
    ends = np.cumsum(lengths)
    words = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(letters)])
    words, spoken = words.dictionary_encode(), pa.array(langs, pa.string()).dictionary_encode()
    n_words = len(words.dictionary)
    key, ids = np.unique(spoken.indices.to_numpy().astype(np.int64) * n_words + words.indices.to_numpy(), return_inverse=True)
    counts = np.bincount(ids, minlength=len(key))
    number = np.empty(len(key), np.int64)
    number[np.argsort(-counts, kind="stable")] = np.arange(1, len(key) + 1)  # common words get small numbers, which pack well
    lang, word = key // n_words, words.dictionary.take(pa.array(key % n_words))
    where = np.flatnonzero(fresh)
    text = np.insert(number[ids], where, 0)
    rows = [{"kind": TEXT, "shard": shard, "a": packed(thinned(text))}]
    for code, name in enumerate(spoken.dictionary.to_pylist()):
        mine = np.flatnonzero(lang == code)
        rows.append({"kind": TOTAL, "shard": shard, "lang": name, "n": int(counts[mine].sum())})
        mine = mine[pc.sort_indices(word.take(pa.array(mine))).to_numpy()]
        taken = word.take(pa.array(mine))
        raw, offsets = text_bytes(taken)
        bucket = (SpanHashes(raw).of(offsets[:-1], offsets[1:]) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        for one in np.split(order, cuts[1:]):
            joined = "\n".join(taken.take(pa.array(one)).to_pylist()).encode()
            rows.append({"kind": RUN, "shard": shard, "bucket": int(bucket[one[0]]), "lang": name, "a": packed_text(joined),
                         "b": packed(counts[mine[one]]), "c": packed(number[mine[one]])})
    return _rows(rows)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each key, which stand together."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for value, group in groupby(rows, key=lambda r: r[key]):
        yield value, list(group)


def _sum_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The words of a bucket that occur often enough in all shards, and for each shard which of its own they are."""
    for bucket, rows in _grouped(batches, "bucket"):
        frequent, out = 0, []
        for lang, runs in groupby(sorted(rows, key=lambda r: r["lang"]), key=lambda r: r["lang"]):
            runs = list(runs)
            words = pa.chunked_array([pa.array(unpacked_text(r["a"]).decode().split("\n"), pa.large_string()) for r in runs]).combine_chunks().dictionary_encode()
            ids, counts = words.indices.to_numpy().astype(np.int64), np.concatenate([unpacked(r["b"]) for r in runs])
            total = np.zeros(len(words.dictionary), np.int64)
            np.add.at(total, ids, counts)
            often = np.flatnonzero(total >= least)
            often = often[pc.sort_indices(words.dictionary.take(pa.array(often))).to_numpy()]
            gids = np.full(len(total), -1, np.int64)
            gids[often] = (bucket << 31) + frequent + np.arange(len(often))
            frequent += len(often)
            for i in often:
                out.append({"kind": PHRASE, "lang": lang, "phrase": words.dictionary[int(i)].as_py(), "gid": int(gids[i]), "n": int(total[i])})
            edges = np.cumsum([0, *(len(unpacked(r["b"])) for r in runs)])
            for r, start, stop in zip(runs, edges[:-1], edges[1:], strict=True):
                found = gids[ids[start:stop]]
                if (found >= 0).any():
                    out.append({"kind": LIST, "shard": r["shard"], "a": packed(unpacked(r["c"])[found >= 0]), "c": packed(found[found >= 0])})
        yield _rows(out)


def _sum_phrases(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The longer phrases of a bucket that occur often enough in all shards, and for each shard which of its own they are."""
    for bucket, runs in _grouped(batches, "bucket"):
        heads, tails, counts = (np.concatenate([unpacked(r[c]) for r in runs]) for c in ("a", "b", "c"))
        order = np.lexsort((tails, heads))
        begins = np.flatnonzero(np.r_[True, (heads[order][1:] != heads[order][:-1]) | (tails[order][1:] != tails[order][:-1])])
        total = np.add.reduceat(counts[order], begins)
        often = total >= least
        number = np.where(often, (bucket << 31) + np.cumsum(often) - 1, -1)
        gids = np.empty(len(order), np.int64)
        gids[order] = np.repeat(number, np.diff(np.r_[begins, len(order)]))
        first = order[begins[often]]
        out = [{"kind": PHRASE, "gid": int(g), "head": int(h), "tail": int(t), "n": int(n)}
               for g, h, t, n in zip(number[often], heads[first], tails[first], total[often], strict=True)]
        edges = np.cumsum([0, *(len(unpacked(r["a"])) for r in runs)])
        for r, start, stop in zip(runs, edges[:-1], edges[1:], strict=True):
            some = np.flatnonzero(gids[start:stop] >= 0) + start
            if len(some):
                out.append({"kind": LIST, "shard": r["shard"], "a": packed(heads[some]), "b": packed(tails[some]), "c": packed(gids[some])})
        yield _rows(out)


def _places(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands among others."""
    order = np.argsort(among)
    return order[np.searchsorted(among, values, sorter=order)]


def _extend(batches: Iterator[pa.RecordBatch], length: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """From a shard's text and its frequent phrases of ``length`` words to runs of phrases one word longer.

    A text row holds word ids (a), the numbers of the words (b), the frequent phrases of one word less by number (c) and
    as lines of word ids (d); lists of what is frequent now follow it. The text that is passed on holds only what the frequent phrases cover.
    """
    for shard, rows in _grouped(batches, "shard"):
        row, lists = rows[0], rows[1:]
        if not lists or row["kind"] != TEXT:  # nothing of the shard is frequent
            continue
        text, (first, gids) = unpacked(row["a"]), (np.concatenate([unpacked(r[c]) for r in lists]) for c in ("a", "c"))
        order = np.argsort(gids)
        first, gids = first[order], gids[order]
        if length == 1:
            order = np.argsort(first)  # the words keep the order of their numbers in the shard, common ones first
            first, gids = first[order], gids[order]
            vocabulary, renamed = gids, np.zeros(int(text.max(initial=0)) + 1, np.int64)
            renamed[first] = np.arange(1, len(gids) + 1)
            text, phrases = thinned(renamed[text]), np.arange(1, len(gids) + 1)[:, None]
        else:
            vocabulary, before = unpacked(row["b"]), unpacked(row["c"])
            lines = unpacked(row["d"]).reshape(len(before), length - 1)
            rest = lines[_places(before, np.concatenate([unpacked(r["b"]) for r in lists])[order])]
            phrases = np.concatenate([_places(vocabulary, first)[:, None] + 1, rest], axis=1)
        word, line, counts, text = extensions(text, phrases)
        heads, tails = vocabulary[word - 1], gids[line]
        out = [{"kind": TEXT, "shard": shard, "a": packed(text), "b": packed(vocabulary), "c": packed(gids), "d": packed(phrases.ravel())}]
        bucket = (texts.mixed(heads.astype(np.uint64) * texts.GOLDEN + tails.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((tails, heads, bucket))
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        for one in np.split(order, cuts[1:]) if len(order) else []:
            out.append({"kind": RUN, "shard": shard, "bucket": int(bucket[one[0]]), "a": packed(heads[one]), "b": packed(tails[one]), "c": packed(counts[one])})
        yield _rows(out)


def _by_kind(rows: DataFrame) -> tuple[DataFrame, str]:
    """A written table with a folder per kind of row, so that runs can go once they are summed; its path."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "table")
    before = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, "8")  # a task keeps a file per kind open instead of sorting its rows by kind
    try:
        with shuffles_removed(spark):
            rows.write.partitionBy("kind").parquet(path)
    finally:
        spark.conf.set(WRITERS, before)
    return spark.read.schema(rows.schema).parquet(path), path


def phrase_counts(
    docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang",
    shard_words: int = SHARD_WORDS, bucket_bytes: int = BUCKET_BYTES,
) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f, gid) of the phrases of 1, 2, ... words that occur ``least`` times or more, and n by language.

    Each shard of the texts is indexed over word ids. Its frequent phrases are searched in the index and extended by the words
    before them; the counts are summed over all shards in packed runs, a bucket of phrases per task; what is frequent goes back to
    the shards that hold it. So a phrase is counted only where all its parts are known to be frequent everywhere, and no
    list of words or phrases is ever collected or broadcast as a whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    made, path = _by_kind(rows.mapInArrow(lambda b: _tokenise(b, n_buckets, shard_words), FIELDS))
    totals = cut_lineage(made.filter(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n")))
    tables: list[DataFrame] = []
    for length in range(1, longest + 1):
        add = _sum_words if length == 1 else _sum_phrases
        runs = made.filter(F.col("kind") == RUN).repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket")
        summed = cut_lineage(runs.mapInArrow(lambda b, add=add: add(b, least), FIELDS))
        state.drop_folders(spark, [f"{path}/kind={RUN}"])
        found = summed.filter(F.col("kind") == PHRASE).withColumnRenamed("n", "f")
        if length == 1:
            tables.append(found.select("gid", "lang", "phrase", "f"))
        else:
            heads, tails = tables[0].select(F.col("gid").alias("head"), F.col("phrase").alias("word")), tables[-1]
            tails = tails.select(F.col("gid").alias("tail"), F.col("lang"), F.col("phrase").alias("rest"))
            named = lookup_join(lookup_join(found.select("gid", "head", "tail", "f"), heads, ["head"], salt_on="gid"), tails, ["tail"], salt_on="gid")
            tables.append(cut_lineage(named.select("gid", "lang", F.concat_ws(" ", "word", "rest").alias("phrase"), "f")))
        if length < longest:
            lists = summed.filter(F.col("kind") == LIST)
            both = spark.read.schema(made.schema).parquet(path).filter(F.col("kind") == TEXT).select(*lists.columns).unionByName(lists)
            dealt = both.repartition("shard").sortWithinPartitions("shard", "kind")
            longer, after = _by_kind(dealt.mapInArrow(lambda b, n=length: _extend(b, n, n_buckets), FIELDS))
            state.drop_folders(spark, [path])
            made, path = longer, after
        if length > 1:
            release(summed)  # the words are still read from the first sum
    state.drop_folders(spark, [path])
    return tables, totals


def mine_phrases(
    docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang",
    shard_words: int = SHARD_WORDS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` best phrases of 2 to ``longest`` words of every language.

    Texts are in lower case (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs.
    n counts a language's words, f a phrase's occurrences within pieces, overlaps included. Candidates have a = f >= ``least``.
    A cut after k words gives l and r, the counts of both parts, and the score floor(1000 * a * n / (l * r)); the lowest cut
    counts, of equal ones that with the smallest k. Candidates inside a longer candidate with at least ``share`` percent of
    their count are dropped; as no phrase is more frequent than a part of it, one more word on either side decides that.
    Best are the highest score, then a, then the phrase in byte order. The arithmetic is exact (38 digits).

    Null texts are empty, null languages ``und``. Repeated rows count as often. An empty table gives no rows.
    """
    tables, totals = phrase_counts(docs, longest, least, text_col, lang_col, shard_words, bucket_bytes)
    known = cut_lineage(_union(tables))
    for one in tables:
        release(one)
    found = known.filter(F.instr("phrase", " ") > 0).withColumn("words", F.split("phrase", " "))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"),
    )
    for side, count in (("left", "l"), ("right", "r")):
        counts = known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cuts = lookup_join(cuts, counts, ["lang", side], salt_on="phrase")
    cuts = lookup_join(cuts, totals, ["lang"], salt_on="phrase")
    whole = lambda name: f"CAST({name} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 * {whole('a')} AS DECIMAL(23, 0)) * {whole('n')}) div ({whole('l')} * {whole('r')})").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest)
    inside = [found.select("lang", part(start, F.size("words") - 1).alias("phrase"), "f") for start in (F.lit(1), F.lit(2))]
    longer = inside[0].unionByName(inside[1]).filter(F.instr("phrase", " ") > 0).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0].select("lang", "phrase", "f")
    for one in tables[1:]:
        whole = whole.unionByName(one.select("lang", "phrase", "f"))
    return whole
