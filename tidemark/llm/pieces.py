"""SentencePiece encoding and decoding with a given vocabulary: a lattice of pieces per word, folded in merge order."""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import SpanHashes, map_texts, text_bytes
from tidemark.operators.joins import lookup_join
from tidemark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE_MARK = "▁"
FOLD_CHARS = 61  # the cuts of a word are the bits of a long, below its sign
DICTIONARY_WORDS = 100_000
CACHED_WORDS = 100_000
BATCH = 768 * 1024  # bytes of text encoded at a time: what the arrays of a worker take is some fifty times as much
STEPS = 64
FILTER_BITS = 20
# Fixed values of the model format: the kinds of pieces and of models.
NORMAL, USER_DEFINED, BYTE, BPE = 1, 4, 6, 2


class Vocabulary:
    """The pieces of a byte-pair model with byte fallback, spaces in place of the space mark.

    ``irregular`` are pieces that merges in order of score, each piece's own characters alone, do not arrive
    at in time, and pieces that share their score with another. For all others, going through a word's edges
    once in order of score is what merging the best pair again and again does: before a symbol of score s
    exists, everything that could be merged with a better score between its ends has been merged.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_format

        model = model_format.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback are supported")
        if rules.name != "identity" or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave texts as they are are supported")
        self.prefix = " " if rules.add_dummy_prefix else ""
        pieces = list(model.pieces)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.text: list[bytes] = []
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            self.text.append(bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE_MARK, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b"")
        self.ids = {p.piece.replace(SPACE_MARK, " "): i for i, p in enumerate(pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.scores = {piece: pieces[i].score for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        shared: dict[float, int] = {}
        for piece, score in self.scores.items():
            if len(piece) > 1:
                shared[score] = shared.get(score, 0) + 1
        self.irregular = {p for p in self.ids if len(p) > 1 and (shared[self.scores[p]] > 1 or self._merged(p) != ([p], True))}

    def _merged(self, word: str) -> tuple[list[str], bool]:
        """Symbols left after all merges, and whether no merge was better than one before it."""
        symbols, score, falling = list(word), float("inf"), True
        while True:
            pairs = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.scores]
            if not pairs:
                return symbols, falling
            cost, i = min(pairs)
            falling, score = falling and -cost <= score, -cost
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def merge(self, word: str) -> list[int]:
        """Ids of any word, merge by merge: the best pair first, the leftmost of equal ones."""
        symbols, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(symbols):
                whole = symbols[i] + symbols[j]
                if whole in self.scores:
                    heapq.heappush(heap, (-self.scores[whole], i, j, whole))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if not symbols[i] or right[i] != j or symbols[i] + symbols[j] != whole:
                continue
            symbols[i], symbols[j] = whole, ""
            right[i] = right[j]
            if right[j] < len(symbols):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [n for s in symbols if s for n in self.symbol(s)]

    def symbol(self, s: str) -> list[int]:
        """The id of a piece, or those of the bytes of a character that is none."""
        return [self.ids[s]] if s in self.ids else [int(self.byte_ids[b]) for b in s.encode()]

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, cost (the lower, the sooner merged), irregular."""
        rows = [(p, i, -float(self.scores[p]), p in self.irregular) for p, i in self.ids.items()]
        return spark.createDataFrame(rows, "piece string, id int, cost double, irregular boolean")


def split_words(text: Column, prefix: str = " ") -> Column:
    """The words of a text with the spaces before each; no piece reaches from one word into the next."""
    marked = F.concat(F.lit(prefix), F.replace(text, F.lit(SPACE_MARK), F.lit(" ")))
    return F.when(text != "", F.regexp_extract_all(marked, F.lit("( *[^ ]+| +)"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word and ids for the words (distinct, of at most FOLD_CHARS characters) that need no irregular piece.

    Every substring of at most the longest piece's length is joined to the piece table; the pieces found are
    the edges of the word's lattice. The fold goes through them in order of score: an edge whose two ends are
    cuts, with exactly one cut between them, merges its two halves. The cuts are the bits of a long. (The
    path of highest total score, which suits other models, is not what a byte-pair model encodes to.)
    """
    word, n = F.col("word"), F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), n - s)),
        lambda size: F.struct(s.alias("start"), (s + size).alias("end"), F.substring(word, s + 1, size).alias("piece")))))
    edges = words.filter((n > 0) & (n <= FOLD_CHARS)).select("word", F.explode(spans).alias("span")).select("word", "span.*")
    found = lookup_join(edges, vocabulary.table(words.sparkSession), ["piece"], salt_on="word")
    edge = F.struct("cost", "start", "end", "id", "irregular")
    lattice = found.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    lattice = lattice.filter(~F.exists("edges", lambda e: e["irregular"]))

    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i)
    inside = lambda cuts, e: cuts.bitwiseAND(bit(e["end"]) - 1).bitwiseAND(F.bitwise_not(bit(e["start"] + 1) - 1))
    stands = lambda cuts, e: (cuts.bitwiseAND(bit(e["start"])) != 0) & (cuts.bitwiseAND(bit(e["end"])) != 0)
    merges = lambda cuts, e: stands(cuts, e) & (F.bit_count(inside(cuts, e)) == 1)
    cuts = F.aggregate("edges", bit(n + 1) - 1, lambda cuts, e: F.when(merges(cuts, e), cuts.bitwiseXOR(inside(cuts, e))).otherwise(cuts))
    folded = lattice.withColumn("cuts", cuts)

    chosen = F.filter("edges", lambda e: stands(F.col("cuts"), e) & (inside(F.col("cuts"), e) == 0))
    byte_ids = F.array(*[F.lit(int(i)) for i in vocabulary.byte_ids])
    hexadecimal = lambda i: F.hex(F.encode(F.substring(word, i + 1, F.lit(1)), "utf-8"))
    as_bytes = lambda i: F.transform(F.sequence(F.lit(1), F.length(hexadecimal(i)), F.lit(2)), lambda k: F.element_at(
        byte_ids, F.conv(F.substring(hexadecimal(i), k, F.lit(2)), 16, 10).cast("int") + 1))
    known = folded.withColumn("chosen", chosen)
    unknown = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.col("cuts").bitwiseAND(bit(i)) != 0) & (F.col("cuts").bitwiseAND(bit(i + 1)) != 0)
                       & ~F.exists("chosen", lambda e: e["start"] == i))
    parts = F.array_sort(F.concat(
        F.transform("chosen", lambda e: F.struct(e["start"].alias("at"), F.array(e["id"]).alias("ids"))),
        F.transform(unknown, lambda i: F.struct(i.alias("at"), as_bytes(i).alias("ids"))),
    ))
    return known.select("word", F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def frequent_words(docs: DataFrame, text_col: str, prefix: str, most: int) -> DataFrame:
    """The ``most`` words of all documents, or nearly as many, that occur most often.

    Words are counted by steps of the logarithm of their counts, each about one percent wide, and whole steps are taken
    from the top. Where the steps that fit hold fewer than half as many, the next step gives its most frequent words.
    """
    counts = docs.select(F.explode(split_words(F.coalesce(F.col(text_col), F.lit("")), prefix)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter((F.col("n") > 1) & (F.length("word") <= FOLD_CHARS))
    counts = cut_lineage(counts.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    steps = dict(map(tuple, counts.groupBy("step").agg(F.count(F.lit(1))).collect()))  # at most 64 * STEPS
    total, bound = 0, max(steps, default=0) + 1
    for step in sorted(steps, reverse=True):
        if total + steps[step] > most:
            break
        total, bound = total + steps[step], step
    chosen = counts.filter(F.col("step") >= bound).select("word")
    below = max((step for step in steps if step < bound), default=None)
    if below is None or total * 2 >= most:
        return chosen
    more = counts.filter(F.col("step") == below).orderBy(F.desc("n"), "word").limit(most - total)
    return chosen.unionByName(more.select("word"))


class WordTable:
    """Ids by word hash: sorted keys, and where each word's ids lie in one flat array."""

    def __init__(self, keys: np.ndarray, ids: list[np.ndarray]):
        order = np.argsort(keys)
        length = np.array([len(i) for i in ids], dtype=np.int64)
        self.flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
        self.keys, self.begin, self.length = keys[order], (np.cumsum(length) - length)[order], length[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def extended(self, keys: np.ndarray, begin: np.ndarray, length: np.ndarray, flat: np.ndarray) -> WordTable:
        out = WordTable.__new__(WordTable)
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        out.keys = every[order]
        out.begin = np.concatenate([self.begin, begin + len(self.flat)])[order]
        out.length = np.concatenate([self.length, length])[order]
        out.flat = np.concatenate([self.flat, flat])
        return out


class Encoder:
    """Encodes batches of texts: every distinct word once, known ones from a table, others through their lattice."""

    def __init__(self, vocabulary: Vocabulary, words: list[str], ids: list[np.ndarray]):
        self.v = vocabulary
        self.piece_text = vocabulary.text
        pieces = list(vocabulary.ids)
        hashes = self._hashes(pieces)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.id = np.array([vocabulary.ids[p] for p in pieces], dtype=np.int32)[order]
        self.cost = np.array([-vocabulary.scores[p] for p in pieces])[order]
        self.odd = np.array([p in vocabulary.irregular for p in pieces])[order]
        self.may_be = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.may_be[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.dictionary = self.known = WordTable(self._hashes(words), ids)

    @staticmethod
    def _hashes(texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.uint64)
        raw, offsets = text_bytes(pa.array(texts, pa.string()))
        return SpanHashes(raw).of(offsets[:-1], offsets[1:])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, where each text's ids begin, and per text whether its ids give it back (space marks as spaces)."""
        plain = pc.replace_substring(texts, SPACE_MARK, " ")
        marked = pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(self.v.prefix, plain, "")).cast(pa.string())
        raw, offsets = text_bytes(marked)
        n = len(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.ones(n, bool)
        space = raw == 0x20
        begins = np.zeros(len(raw), dtype=bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        spans = SpanHashes(raw)
        keys, first, which = np.unique(spans.of(starts, ends), return_index=True, return_inverse=True)
        _, there = self.known.find(keys)
        new = first[~there]
        if len(new):
            self._learn(keys[~there], raw, spans, starts[new], ends[new])
        at, _ = self.known.find(keys)
        begin, length = self.known.begin[at][which], self.known.length[at][which]
        ids = self.known.flat[ragged(begin, length)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        per_text = np.bincount(row, weights=length, minlength=n).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        same = self._given_back(ids, bounds, raw, offsets)
        if len(self.known.keys) > CACHED_WORDS + len(self.dictionary.keys):
            self.known = self.dictionary
        return ids, bounds, same

    def _given_back(self, ids: np.ndarray, bounds: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.array([len(t) for t in self.piece_text], dtype=np.int64)
        place = np.cumsum(size) - size
        letters = np.frombuffer(b"".join(self.piece_text), np.uint8)
        made = letters[ragged(place[ids], size[ids])]
        edges = np.concatenate([[0], np.cumsum(size[ids])])[bounds]
        same = np.diff(edges) == np.diff(offsets)
        if len(made) == len(raw) and same.all():
            wrong = np.flatnonzero(made != raw)
            same[np.searchsorted(offsets, wrong, side="right") - 1] = False
            return same
        return np.array([np.array_equal(made[edges[i] : edges[i + 1]], raw[offsets[i] : offsets[i + 1]]) for i in range(len(same))])

    def _learn(self, keys: np.ndarray, raw: np.ndarray, spans: SpanHashes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes the words at ``starts`` to ``ends`` and adds them to the table."""
        char = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
        low, high = np.searchsorted(char, starts), np.searchsorted(char, ends)
        n = high - low
        slow = n > FOLD_CHARS
        fast = np.flatnonzero(~slow)
        at = ragged(low[fast], n[fast])  # the characters of all words, by their number in the batch
        owner = np.repeat(np.arange(len(fast)), n[fast])
        place = np.arange(len(at)) - np.repeat(np.cumsum(n[fast]) - n[fast], n[fast])
        edges = []
        byte = np.append(char, len(raw))
        for size in range(1, self.v.longest + 1):
            fits = np.flatnonzero(place + size <= n[fast][owner])
            if not len(fits):
                break
            hashes = spans.of(byte[at[fits]], byte[at[fits] + size])
            maybe = self.may_be[hashes >> np.uint64(64 - FILTER_BITS)]
            fits, hashes = fits[maybe], hashes[maybe]
            entry = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[entry] == hashes
            edges.append((owner[fits[hit]], place[fits[hit]], np.full(hit.sum(), size), entry[hit]))
        word, start, size, entry = (np.concatenate(e) for e in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 4
        slow[fast[np.unique(word[self.odd[entry]])]] = True
        single = np.full(len(at), -1, dtype=np.int64)  # the id of every character that is a piece
        offset = np.cumsum(n[fast]) - n[fast]
        ones = size == 1
        single[offset[word[ones]] + start[ones]] = self.id[entry[ones]]
        many = np.flatnonzero(~ones)
        order = many[np.lexsort((start[many], self.cost[entry[many]], word[many]))]
        word, start, end, entry = word[order], start[order], (start + size)[order], entry[order]
        cuts = self._fold(word, start, end, len(fast), n[fast])

        one = np.uint64(1)
        stands = ((cuts[word] >> start.astype(np.uint64)) & one) & ((cuts[word] >> end.astype(np.uint64)) & one)
        last = (stands == 1) & (self._inside(cuts[word], start, end) == 0)
        # every character: the piece that begins there, its own id, its bytes, or nothing inside a longer piece
        chosen = single.copy()
        begins_here = (cuts[owner] >> place.astype(np.uint64)) & one == 1
        ends_next = (cuts[owner] >> (place + 1).astype(np.uint64)) & one == 1
        chosen[offset[word[last]] + start[last]] = self.id[entry[last]]
        width = np.where(begins_here, 1, 0)
        unknown = np.flatnonzero(begins_here & ends_next & (single < 0))
        width[unknown] = byte[at[unknown] + 1] - byte[at[unknown]]
        flat = np.repeat(chosen, width)
        where = np.cumsum(width) - width
        for c in unknown:
            flat[where[c] : where[c] + width[c]] = self.v.byte_ids[raw[byte[at[c]] : byte[at[c] + 1]]]
        length = np.zeros(len(keys), dtype=np.int64)
        length[fast] = np.bincount(owner, weights=width, minlength=len(fast)).astype(np.int64)
        begin = np.zeros(len(keys), dtype=np.int64)
        begin[fast] = np.cumsum(length[fast]) - length[fast]
        extra = [flat.astype(np.int32)]
        total = len(flat)
        for w in np.flatnonzero(slow):
            ids = self.v.merge(raw[starts[w] : ends[w]].tobytes().decode())
            begin[w], length[w] = total, len(ids)
            extra.append(np.array(ids, dtype=np.int32))
            total += len(ids)
        self.known = self.known.extended(keys, begin, length, np.concatenate(extra))

    @staticmethod
    def _inside(cuts: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cuts strictly between start and end."""
        one = np.uint64(1)
        return cuts & ((one << end.astype(np.uint64)) - one) & ~((one << (start + 1).astype(np.uint64)) - one)

    def _fold(self, word: np.ndarray, start: np.ndarray, end: np.ndarray, words: int, n: np.ndarray) -> np.ndarray:
        """Cuts of every word after its edges, in order, have merged what they can; all words take a step together."""
        one = np.uint64(1)
        cuts = (one << (n + 1).astype(np.uint64)) - one
        count = np.bincount(word, minlength=words)
        first = np.cumsum(count) - count
        by_count = np.argsort(-count, kind="stable")
        sorted_count = -count[by_count]
        for i in range(int(count.max(initial=0))):
            active = by_count[: np.searchsorted(sorted_count, -i, side="left")]
            edge = first[active] + i
            s, e, c = start[edge], end[edge], cuts[active]
            between = self._inside(c, s, e)
            stand = ((c >> s.astype(np.uint64)) & (c >> e.astype(np.uint64)) & one) == 1
            merges = stand & (between != 0) & ((between & (between - one)) == 0)
            cuts[active[merges]] = (c ^ between)[merges]
        return cuts


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (length[0] of them), begin[1], ..."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - length), length)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", dictionary_words: int = DICTIONARY_WORDS,
    ids: str = "ids", round_trip: str = "round_trip",
) -> DataFrame:
    """``docs`` with the text replaced by its ids and by whether they decode to it again.

    The most frequent words of all documents (at most ``dictionary_words``, a few megabytes) are encoded
    once, as a relational lattice, and travel with the tasks; a task encodes its remaining words through the
    same lattice, each distinct word of a batch once. Words of over FOLD_CHARS characters, and those with
    irregular pieces (such as long runs of spaces), are merged step by step. No text is shuffled.

    Null and empty texts have no ids. A text's own space marks come back as spaces, otherwise decoding gives
    the text. Repeated rows give repeated rows, an empty table none; other columns pass through, but columns
    that have the names of the new ones are replaced.
    """
    found = encode_words(frequent_words(docs, text_col, vocabulary.prefix, dictionary_words), vocabulary).toPandas()
    encoder = Encoder(vocabulary, found["word"].tolist(), [np.asarray(i, dtype=np.int32) for i in found["ids"]])
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    docs = docs.drop(ids, round_trip)

    def run(texts: pa.StringArray) -> list:
        flat, bounds, same = shared.value.encode(texts)
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())), same]

    return map_texts(docs, text_col, run, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(round_trip, T.BooleanType())], BATCH)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with its ids replaced by their text; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    pieces, prefix = vocabulary.text, vocabulary.prefix
    others = [f for f in encoded.schema.fields if f.name != ids]

    def run(batches):
        known = pa.array(pieces, pa.large_binary())
        for batch in batches:
            lists = batch.column(ids)
            flat = known.take(lists.flatten())  # null lists have no members
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64))])
            raw, edges = text_bytes(flat)
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(edges[bounds].astype(np.int64)), pa.py_buffer(raw)])
            columns = [batch.column(f.name) for f in others] + [_as_text(texts, prefix)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in others] + [text])

    return encoded.mapInArrow(run, T.StructType([*others, T.StructField(text, T.StringType())]))


def _as_text(raw: pa.LargeBinaryArray, prefix: str) -> pa.StringArray:
    """Bytes as texts without the prefix; only rows that are no UTF-8 are decoded one by one."""
    try:
        texts = raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([t.decode("utf-8", "replace") for t in raw.to_pylist()], pa.large_string())
    if prefix:
        texts = pc.if_else(pc.starts_with(texts, prefix), pc.utf8_slice_codeunits(texts, len(prefix)), texts)
    return texts.cast(pa.string())
