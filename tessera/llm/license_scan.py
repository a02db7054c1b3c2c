"""Licence scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates that differ in a version or variant mark those words, and a match must hold them in one run.  Of matches
that overlap the one that explains most words, and leaves fewest over on either side, stands for them all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm.license_texts import TEMPLATES

#: Words in a fingerprint, and fingerprints in a winnowing window: any run of GRAM + WINDOW - 1 words that a text
#: shares with a template has at least one chosen fingerprint in common.
GRAM, WINDOW = 3, 2
LEAST_COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
TABLE_BITS = 16

#: Words are runs of ASCII letters, digits and bytes beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def fingerprints(hashes: np.ndarray, ends: np.ndarray, powers: _text.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the winnowed word n-grams of rows that end at ``ends``; a row of fewer words has none."""
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    weight = powers.upto(GRAM + 1)
    value = sum((hashes[j : n + j] * weight[j + 1] for j in range(1, GRAM)), hashes[:n] * weight[1])
    value = _text.mix(value) >> np.uint64(1)
    never = np.uint64(2**64 - 1)
    for k in range(1, GRAM):  # n-grams over a row's end
        at = ends - k
        value[at[(at >= 0) & (at < n)]] = never
    padded = np.append(value, np.full(WINDOW - 1, never))
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    chosen = np.zeros(n, bool)
    chosen[np.minimum(np.arange(n) + windows.argmin(axis=1), n - 1)] = True
    at = np.flatnonzero(chosen & (value != never))
    return at, value[at]


def parsed(template: str, powers: _text.Powers) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A template's word hashes, and the runs of words (from, to) that stand in braces."""
    hashes, runs = [], []
    for i, part in enumerate(re.split("[{}]", template)):
        raw = np.frombuffer(part.encode(), np.uint8)
        own = _text.words(raw, np.array([0, len(raw)]), powers, BETWEEN)[0]
        if i % 2 and len(own):
            at = sum(map(len, hashes))
            runs.append((at, at + len(own)))
        hashes.append(own)
    return np.concatenate(hashes), runs


class Templates:
    """An inverted index from fingerprints to (template, place)."""

    def __init__(self, templates: dict[str, str]) -> None:
        powers = _text.Powers()
        self.names, self.words, self.runs, keys, own, places = [], [], [], [], [], []
        for name in sorted(templates):
            hashes, runs = parsed(templates[name], powers)
            self.runs.append(runs)
            at, value = fingerprints(hashes, np.array([len(hashes)]), powers)
            keys.append(value)
            places.append(at)
            own.append(np.full(len(at), len(self.names)))
            self.names.append(name)
            self.words.append(hashes)
        key = np.concatenate(keys or [np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.template, self.place = np.concatenate(own or [np.zeros(0, np.int64)])[order], np.concatenate(places or [np.zeros(0, np.int64)])[order]
        self.key, self.first = np.unique(key[order], return_index=True)
        self.first = np.append(self.first, len(key))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(63 - TABLE_BITS)).astype(np.intp)

    def hits(self, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, template, place in the template) of every fingerprint in common."""
        maybe = self.table[self._slot(value)]
        at, value = at[maybe], value[maybe]
        if not len(at):
            return at, at, at
        slot = np.minimum(np.searchsorted(self.key, value), len(self.key) - 1)
        sure = self.key[slot] == value
        at, slot = at[sure], slot[sure]
        many = self.first[slot + 1] - self.first[slot]
        entry = np.arange(many.sum()) + np.repeat(self.first[slot] - (np.cumsum(many) - many), many)
        return np.repeat(at, many), self.template[entry], self.place[entry]


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, np.ndarray]:
    """Best local alignment on diagonals low..high (text place - template place): matched words, first and last
    place (exclusive) in the text, and each template word's place in the text (-1: not matched)."""
    n, m, width = len(template), len(text), high - low + 1
    place = np.arange(width)
    table = np.zeros((n + 1, width), np.int32)
    for i in range(1, n + 1):
        j = place + low + i - 1  # the text's word met here
        inside = (j >= 0) & (j < m)
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == template[i - 1]
        row = np.maximum(table[i - 1] + np.where(same, MATCH, MISMATCH), 0)
        row[:-1] = np.maximum(row[:-1], table[i - 1, 1:] + GAP)
        row = np.where(inside, row, 0)
        table[i] = np.where(inside, np.maximum.accumulate(row - GAP * place) + GAP * place, 0)
    where = np.full(n, -1, np.int64)
    if not table.any():
        return 0, 0, 0, where
    i, k = np.unravel_index(int(table.argmax()), table.shape)
    end, start = low + int(k) + int(i), low + int(k) + int(i)
    while i > 0 and table[i, k] > 0:
        j = low + k + i - 1
        same = bool(text[j] == template[i - 1])
        if table[i, k] == max(table[i - 1, k] + (MATCH if same else MISMATCH), 0):
            if same:
                where[i - 1] = j
            start = j
            i -= 1
        elif k + 1 < width and table[i, k] == table[i - 1, k + 1] + GAP:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return int(np.count_nonzero(where >= 0)), start, end, where


def accepted(template: np.ndarray, runs: list[tuple[int, int]], text: np.ndarray, low: int, high: int, least: float) -> Iterator[tuple[int, int, int]]:
    """(matched, first, end) of the matches on diagonals low..high, best first, then on either side of it."""
    if len(text) < least * len(template) or low > high:
        return
    matched, first, end, where = align(template, text, low, high)
    if matched < least * len(template):
        return
    whole = all(where[a] >= 0 and np.array_equal(where[a:b], where[a] + np.arange(b - a)) for a, b in runs)
    if whole and matched >= least * (end - first):
        yield matched, first, end
    for a, b in ((0, first), (end, len(text))):
        for count, x, y in accepted(template, runs, text[a:b], max(low - a, -len(template)), min(high - a, b - a), least):
            yield count, x + a, y + a


def settled(found: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of (template, matched, first, end) that overlap, the one with the most matched words over what is unmatched in
    the template and in the text; then the earlier, the shorter, the lesser name.  In the order of the text."""
    order = sorted(set(found), key=lambda f: (f[3] - f[2] + sizes[f[0]] - 3 * f[1], f[2], f[3], f[0]))
    out: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    for f in order:
        at = bisect_left(starts, f[2])
        if (at == 0 or out[at - 1][3] <= f[2]) and (at == len(out) or starts[at] >= f[3]):
            out.insert(at, f)
            starts.insert(at, f[2])
    return out


FOUND = "doc_id long, license string, coverage double, matched int, start long, end long"


def _scan(templates: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, powers = Templates(templates), _text.Powers()
        for batch in batches:
            raw, offsets = _text.utf8(batch.column(1))
            out = []
            for lo, hi in _text.chunks(offsets):
                out += list(_matches(index, powers, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, least))
            chars = lambda r, b: int(np.count_nonzero((raw[offsets[r] : offsets[r] + b] & 0xC0) != 0x80))
            rows = [(batch.column(0)[r].as_py(), name, covered, matched, chars(r, a), chars(r, b)) for r, name, covered, matched, a, b in out]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["doc_id", "license", "coverage", "matched", "start", "end"])

    return run


def _matches(index: Templates, powers: _text.Powers, raw: np.ndarray, offsets: np.ndarray, base: int, least: float) -> Iterator[tuple]:
    """(row, template, coverage, matched words, first and last byte in the row)."""
    hashes, at, starts, lengths = _text.words(raw, offsets, powers, BETWEEN)
    where, template, place = index.hits(*fingerprints(hashes, at[1:], powers))
    if not len(where):
        return
    row, diagonal = np.searchsorted(at, where, "right") - 1, where - place
    order = np.lexsort((diagonal, template, row))
    row, template, diagonal = row[order], template[order], diagonal[order]
    slack = np.array([max(4, len(w) // 6) for w in index.words])
    sizes = [len(w) for w in index.words]
    # a candidate: hits of one row and template on neighbouring diagonals; a long chain of them is taken in windows that
    # overlap by all that a match may shift
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[template[1:]])
    cut = np.append(np.flatnonzero(new), len(row))
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        r, t = int(row[a]), int(template[a])
        words, room, last = index.words[t], int(slack[t]), int(diagonal[b - 1])
        for d in range(int(diagonal[a]), last + 1, 2 * len(words) + room):
            low, high = d - room, min(d + 2 * len(words) + room, last) + room
            lo, hi = max(int(at[r]), low), min(int(at[r + 1]), high + len(words))
            for matched, first, end in accepted(words, index.runs[t], hashes[lo:hi], low - lo, high - lo, least):
                found.setdefault(r, []).append((t, matched, first + lo, end + lo))
    for r in sorted(found):
        for t, matched, first, end in settled(found[r], sizes):
            yield base + r, index.names[t], matched / sizes[t], matched, int(starts[first] - offsets[r]), int(starts[end - 1] + lengths[end - 1] - offsets[r])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places where a text holds at least ``least_coverage`` of a template's words in order.

    One row per place: doc_id, license, coverage (matched words over the template's), matched, start and end
    (characters).  As large a share of the place's own words must be matched, and every run of words that the template
    has in {braces}, without a gap.  Places do not overlap: the best explained is reported, ties go to the earlier, the
    shorter, the lesser name.  Templates of under GRAM + WINDOW - 1 words are not sure to be found.  Null and empty texts
    match nothing; repeated rows report each; a null id is reported as null.  Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_text.lean(_scan(TEMPLATES if templates is None else templates, least_coverage)), FOUND)
