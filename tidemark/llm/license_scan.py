"""License notices in texts: fingerprints pick templates and stretches, longest common subsequences measure them."""

from __future__ import annotations

import bisect
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import SpanHashes, joined_hashes, map_texts, spread, text_bytes
from tidemark.llm.license_texts import HEADERS, bodies

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM, WINDOW, BAND = 3, 1, 8  # a window of 1 indexes every gram; wider ones lose edited notices
TEMPLATE_BYTES = 16 * 1024 * 1024
# Short notices as projects write them. The words, not their case or punctuation, are compared.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without permission"),
    ("all-rights-reserved", "All rights reserved"),
]

FOLD = np.zeros(256, dtype=np.uint8)  # 0 for separators, lower case for letters, bytes beyond ASCII as they are
FOLD[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]] = [ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]
FOLD[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = [ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]
FOLD[128:] = np.arange(128, 256)


def tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end (bytes within its text) and row of every run of letters, digits or bytes beyond ASCII, in lower case."""
    raw, offsets = text_bytes(texts)
    folded = FOLD[raw]
    solid = folded > 0
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < len(raw))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return SpanHashes(folded).of(starts, ends), starts - offsets[row], ends - offsets[row], row


def winnowed(grams: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest gram hash of every ``window`` neighbouring grams of one owner, each place once.

    Owners with fewer grams than a window keep their smallest one. Two texts that share ``window + gram - 1``
    tokens in a row share a fingerprint.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    for i in range(1, window):
        other = np.minimum(np.arange(n) + i, n - 1)
        better = (owner[other] == owner) & (grams[other] < grams[best])
        best = np.where(better, other, best)
    count = np.bincount(owner)
    last = np.cumsum(count)[owner] - 1
    whole = np.arange(n) + window - 1 <= last
    first = np.cumsum(count)[owner] - count[owner]
    return np.unique(best[whole | ((np.arange(n) == first) & (count[owner] < window))])


def gram_hashes(hashes: np.ndarray, row: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of every ``gram`` neighbouring tokens of one row."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.cumsum(np.bincount(row))[row]
    first = np.flatnonzero(np.arange(len(row)) + gram <= last)
    return first, joined_hashes(hashes, first, gram) + spread(gram)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """Pairs (template token, text token) of a longest common subsequence within ``band`` of the diagonal text = template + shift."""
    n, width = len(template), 2 * band + 1
    best = np.zeros((n + 1, width + 2), dtype=np.int32)  # cell d of row i: text tokens up to i + shift + d - band
    step = np.zeros((n + 1, width + 2), dtype=np.int8)
    for i in range(1, n + 1):
        for d in range(width):
            j = i + shift + d - band  # length of the text prefix
            up, left = best[i - 1, d + 1], best[i, d - 1] if d else 0
            value, how = (up, 1) if up >= left else (left, 2)
            if 1 <= j <= len(text) and template[i - 1] == text[j - 1] and best[i - 1, d] + 1 >= value:
                value, how = best[i - 1, d] + 1, 3
            best[i, d], step[i, d] = value, how
    i, d, pairs = n, int(np.argmax(best[n, :width])), []
    while i > 0 and 0 <= d < width and best[i, d]:
        if step[i, d] == 3:
            pairs.append((i - 1, i + shift + d - band - 1))
            i -= 1
        elif step[i, d] == 1:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return pairs[::-1]


def _reach(masks: list[int], n: int, row: list[int]) -> tuple[int, int]:
    """Length of a longest common subsequence of a template of ``n`` tokens and ``row``, and how much of ``row`` it takes.

    Bit-parallel: bit i is 0 where template tokens up to i hold one match more than those before. Entries of
    -1 are tokens that the template does not have.
    """
    full = (1 << n) - 1
    v, best, end = full, 0, 0
    for j, x in enumerate(row, 1):
        if x >= 0 and (u := v & masks[x]):
            v = ((v + u) | (v - u)) & full
            count = n - v.bit_count()
            if count > best:
                best, end = count, j
    return best, end


class Pattern:
    """One template: how many of its tokens a match needs (``need``), over how many tokens of a text at most (``most``)."""

    def __init__(self, hashes: np.ndarray, gram: int, least: float):
        self.n = n = len(hashes)
        self.need = max(1, math.ceil(least * n))
        self.most = n + max(2 * BAND, math.ceil(n / 4))
        # with no more than n - need tokens changed or left out, a run of this many is whole somewhere
        self.run = min(gram, -(-self.need // (n - self.need + 1))) if n else gram
        self.hashes = hashes
        self.vocabulary, local, self.counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.local = local.tolist()
        self.masks: tuple[list[int], list[int]] | None = None

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of every token in the template's vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def reach(self, row: list[int], backward: bool = False) -> tuple[int, int]:
        if self.masks is None:
            there, back = [0] * len(self.vocabulary), [0] * len(self.vocabulary)
            for i, x in enumerate(self.local):
                there[x] |= 1 << i
                back[x] |= 1 << self.n - 1 - i
            self.masks = there, back
        return _reach(self.masks[backward], self.n, row)

    def could(self, row: np.ndarray) -> bool:
        """Whether ``row`` has enough of the template's tokens in any order."""
        if len(row) < self.need:
            return False
        return int(np.minimum(np.bincount(row[row >= 0], minlength=len(self.counts)), self.counts).sum()) >= self.need

    def spans(self, row: np.ndarray, marks: list[int], lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """Non-overlapping spans (start, end, tokens matched) of ``row[lo:hi]`` such that no other fits between them.

        A span has at most ``most`` tokens, holds at least ``need`` of the template's tokens in order, and a
        run of ``run`` of them that begins at one of ``marks``.
        """
        while hi - lo >= self.need:
            top = min(hi, lo + 2 * self.most)
            span = self._fullest(row, marks, lo, top) if self.could(row[lo:top]) else None
            if span is None:
                if top == hi:
                    return
                lo += self.most
                continue
            start, end, _ = span
            yield from self.spans(row, marks, lo, start)
            if start >= lo + self.most and top < hi:
                lo = start  # the window may end within this one
            else:
                yield span
                lo = end

    def _fullest(self, row: np.ndarray, marks: list[int], lo: int, top: int) -> tuple[int, int, int] | None:
        whole = row[lo:top].tolist()

        def tight(a: int, b: int) -> tuple[int, int, int]:
            count, end = self.reach(whole[a:b])
            return a + end - (self.reach(whole[a : a + end][::-1], True)[1] if count >= self.need else 0), a + end, count

        def marked(a: int, b: int) -> bool:
            i = bisect.bisect_left(marks, lo + a)
            return i < len(marks) and marks[i] + self.run <= lo + b

        a, b, count = tight(0, len(whole))
        if count < self.need:
            return None
        if b - a <= self.most and marked(a, b):
            return lo + a, lo + b, count
        # matched tokens lie too far apart: every start on its own, past those that cannot hold more
        best, at = None, 0
        while at < min(self.most, len(whole)):
            a, b, count = tight(at, at + self.most)
            wanted = max(self.need, best[2] + 1 if best else 0)
            if count >= wanted and marked(a, b):
                best = (lo + a, lo + b, count)
            at += max(1, wanted - count)
        return best


class TemplateIndex:
    """Fingerprints of the templates in order of their hash, with the template and token each stands at."""

    def __init__(self, names: list[str], texts: list[str], gram: int = GRAM, window: int = WINDOW, least: float = 0.8):
        self.names = names
        hashes, _, _, row = tokens(pa.array(texts, pa.string()))
        self.patterns = [Pattern(hashes[row == i], gram, least) for i in range(len(texts))]
        self.need = np.array([p.need for p in self.patterns], dtype=np.int64)
        self.sizes = sorted({p.run for p in self.patterns})
        begin = np.searchsorted(row, np.arange(len(texts)))
        run = np.array([p.run for p in self.patterns], dtype=np.int64)
        keys, template, token = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.sizes:
            first, grams = gram_hashes(hashes, row, size)
            mine = run[row[first]] == size
            first, grams = first[mine], grams[mine]
            places = winnowed(grams, row[first], window)
            keys.append(grams[places])
            template.append(row[first[places]])
            token.append(first[places] - begin[template[-1]])
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.template, self.token = (np.concatenate(v)[order] for v in (keys, template, token))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every gram found in the index one entry per place: position in ``grams`` and index entry."""
        low, high = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        found = np.flatnonzero(high > low)
        many = (high - low)[found]
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[found], many)
        return np.repeat(found, many), entry


def _stretches(index: TemplateIndex, hashes: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple]]:
    """Per text (template, first token, places in the template's vocabulary, marks) of every stretch that a match can lie in."""
    token, template = [], []
    for size in index.sizes:
        # a text is fingerprinted at every place, so that it cannot miss a template's fingerprint by its own window
        first, grams = gram_hashes(hashes, row, size)
        at, entry = index.hits(grams)
        token.append(first[at])
        template.append(index.template[entry])
    token, template = np.concatenate(token), np.concatenate(template)
    long_enough = np.diff(bounds)[row[token]] >= index.need[template]
    pairs = np.unique(np.stack([row[token], template, token], 1)[long_enough], axis=0)
    edges = np.flatnonzero((pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)) + 1
    found: dict[int, list[tuple]] = {}
    for group in np.split(pairs, edges) if len(pairs) else []:
        text, name = int(group[0, 0]), int(group[0, 1])
        pattern = index.patterns[name]
        marks = group[:, 2]
        cuts = np.flatnonzero(np.diff(marks) > 2 * pattern.most) + 1
        for part in np.split(marks, cuts):
            lo = max(int(bounds[text]), int(part[0]) + pattern.run - pattern.most)
            hi = min(int(bounds[text + 1]), int(part[-1]) + pattern.most)
            places = pattern.places(hashes[lo:hi])
            if pattern.could(places):
                found.setdefault(text, []).append((name, lo, places, (part - lo).tolist()))
    return found


def scan(texts: pa.StringArray, index: TemplateIndex) -> list[list[dict]]:
    """Matches per text: license, coverage, start and end (code points), none overlapping."""
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    hashes, starts, ends, row = tokens(texts)
    if not len(row) or not index.sizes:
        return found
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for text, stretches in _stretches(index, hashes, row, bounds).items():
        kept: list[dict] = []
        while stretches:
            # a stretch that lost a match to a fuller one is looked through again beside what stayed
            tried = []
            for stretch in stretches:
                name, first, places, marks = stretch
                pattern, lo = index.patterns[name], 0
                taken = [(m["start"] - first, m["end"] - first) for m in kept]
                mine = []
                for a, b in [*((a, b) for a, b in taken if b > 0 and a < len(places)), (len(places), len(places))]:
                    mine += pattern.spans(places, marks, lo, min(a, len(places)))
                    lo = max(lo, b)
                tried.append((stretch, [{
                    "license": index.names[name], "coverage": count / pattern.n, "count": count, "start": first + s, "end": first + e,
                } for s, e, count in mine]))
            kept = _apart(kept + [m for _, ms in tried for m in ms])
            stays = {id(m) for m in kept}
            stretches = [stretch for stretch, ms in tried if any(id(m) not in stays for m in ms)]
        if kept:  # code points before every byte of this text
            value = np.frombuffer(texts[text].as_py().encode(), np.uint8)
            before = np.concatenate([[0], np.cumsum((value & 0xC0) != 0x80)])
            found[text] = [m | {"start": int(before[starts[m["start"]]]), "end": int(before[ends[m["end"] - 1]])} for m in kept]
    return found


def _apart(matches: list[dict]) -> list[dict]:
    """Of matches that overlap, the one that holds most of a template's tokens, then the higher coverage, stays."""
    kept: list[dict] = []
    begins: list[int] = []
    for m in sorted(matches, key=lambda m: (-m["count"], -m["coverage"], m["start"], m["license"], m["end"])):
        i = bisect.bisect_left(begins, m["start"])
        before, after = kept[i - 1] if i else None, kept[i] if i < len(kept) else None
        if (before is None or before["end"] <= m["start"]) and (after is None or m["end"] <= after["start"]):
            kept.insert(i, m)
            begins.insert(i, m["start"])
    return kept


def default_templates() -> list[tuple[str, str]]:
    """Notices, headers, identifier lines and whole texts of common licenses."""
    return [*NOTICES, *HEADERS, *bodies()]


def license_matches(
    docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, least: float = 0.8, gram: int = GRAM, window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id and matches (license, coverage, start, end in code points) per row of ``docs``, whole texts.

    Texts and templates are compared as runs of letters and digits in lower case. The templates' ``gram``-token
    fingerprints form an inverted index (of short templates smaller grams, so that as many changed or missing
    tokens as ``least`` allows leave one whole); a text's hits name templates and stretches. A match is a span of
    at most a quarter more tokens than the template (16 more for templates of fewer than 64) that holds a
    fingerprint and at least ``least`` of the template's tokens, in order. Of overlapping matches the one with most
    of these tokens, then the fullest, stays (a license text, not the notice inside it), and no further match lies
    between those reported. Without ``templates`` the notices, headers, identifier lines and whole texts of common
    licenses are searched.

    Templates (name, text) travel with the tasks and are refused beyond ``TEMPLATE_BYTES``; null templates
    are left out, so are those without tokens. ``window`` thins the index and loses edited notices beyond 1. Null
    and empty texts have no matches, repeated rows give repeated rows, an empty table none.
    """
    if templates is None:
        templates = default_templates()
    elif isinstance(templates, DataFrame):
        name, text = templates.columns[:2]
        size = templates.agg(F.sum(F.octet_length(text))).first()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"{size} bytes of templates; at most {TEMPLATE_BYTES} can travel with the tasks")
        templates = [(r[0], r[1]) for r in templates.filter(F.col(text).isNotNull()).select(name, text).collect()]
    index = TemplateIndex([n for n, _ in templates], [t for _, t in templates], gram, window, least)
    match = T.StructType([
        T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])

    def run(texts: pa.StringArray) -> list:
        return [[[{k: m[k] for k in ("license", "coverage", "start", "end")} for m in ms] for ms in scan(texts, index)]]

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return map_texts(rows, "_text", run, [T.StructField("matches", T.ArrayType(match))])
