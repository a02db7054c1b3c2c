"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment.

Letters are case-folded where the folded form is of the same length in UTF-8 (A-Z and nearly all of Latin, Greek,
Cyrillic and the other scripts with case) and white-space runs become one space.  An item of L bytes may have
e = ERROR_RATE * L edits.  A region within e edits of it shares at least L - Q + 1 - Q e of its q-grams, on at
most e + 1 neighbouring diagonals.  Bands are 2 (e + 1) diagonals wide and begin every e + 1, so one band holds
them all.  Windows with too few q-grams of any item are passed over before bands are counted; that bound
follows from the same lemma, so it loses nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text

Q = 8
ERROR_RATE = 0.08
TABLE_BITS = 20
SEGMENT = 1 << 20
#: Bytes of items that are sent to the executors at once; more items take more scans.
ITEM_BYTES = 4 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _folds() -> np.ndarray:
    """The UTF-8 bytes, as one number, that a character's case-folded form has; 0 for those that stay."""
    out = np.zeros(0x1E944, np.uint32)
    for code in range(0x80, len(out)):
        if not 0xD800 <= code < 0xE000:
            own, folded = chr(code).encode(), chr(code).casefold().encode()
            if own != folded and len(own) == len(folded):
                out[code] = int.from_bytes(folded, "big")
    return out


FOLDS = _folds()


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with letters case-folded in place."""
    out = _text.LOWER[data]
    for size, least, most in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        at = np.flatnonzero((data >= least) & (data <= most))
        at = at[at + size <= len(data)]
        if not len(at):
            continue
        code = data[at].astype(np.int64) & (0x7F >> size)
        for k in range(1, size):
            code = code << 6 | data[at + k] & 0x3F
        folded = FOLDS[np.minimum(code, len(FOLDS) - 1)]
        folded[code >= len(FOLDS)] = 0
        at, folded = at[folded > 0], folded[folded > 0]
        for k in range(size):
            out[at + k] = folded >> np.uint32(8 * (size - 1 - k)) & np.uint32(0xFF)
    return out


def normalise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded bytes with single spaces and none at the ends, and each byte's place in ``raw``."""
    space = _text.IS_SPACE[raw]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.flatnonzero(keep)
    if len(place) and space[place[-1]]:
        place = place[:-1]
    if len(place) and space[place[0]]:
        place = place[1:]
    out = fold(raw[place])
    out[_text.IS_SPACE[out]] = 0x20
    return out, place


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on, as one number."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - Q + 1),), np.uint64, data, strides=(1,)) if len(data) >= Q else np.zeros(0, np.uint64)


class Index:
    """The q-grams of a set of items (id, text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE) -> None:
        self.ids, self.items = [], []
        for item_id, text in items:
            data, _ = normalise(np.frombuffer((text or "").encode(), np.uint8))
            if len(data) >= Q:
                self.ids.append(item_id)
                self.items.append(data)
        size = np.array([len(x) for x in self.items], np.int64)
        self.size = size
        self.edits = np.minimum((rate * size).astype(np.int64), (size - Q) // Q) if len(size) else size
        self.least = size - Q + 1 - Q * self.edits
        keys = [grams(x) for x in self.items]
        self.key, at = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_inverse=True)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys] or [np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        self.item, self.place = item[order], place[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.key) + 1))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.key)] = True
        self.shift = int(size.max(initial=0)) + int(self.edits.max(initial=0)) + 1
        reach = size + self.edits
        self.window = int(reach.min()) if len(reach) else 1
        self.needed = int(np.ceil((self.least / -(-reach // self.window)).min())) if len(reach) else 1
        self.margin = int(reach.max() + self.edits.max()) + Q if len(reach) else 0

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * _SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)

    def matches(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) in ``data``, rows ending at ``ends``; start and end count within data.

        Places may overlap; settled() chooses among them.
        """
        n = len(data) - Q + 1
        if n <= 0 or not len(self.items):
            return []
        key = grams(data)
        hit = self.table[self._slot(key)]
        for k in range(1, Q):  # grams over a row's end
            at = ends[:-1] - k
            hit[at[(at >= 0) & (at < n)]] = False
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
        width = min(self.window, n)
        dense = np.flatnonzero(total[width:] - total[:-width] >= self.needed)
        if not len(dense):
            return []
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(dense - self.margin, 0), 1)
        np.add.at(mark, np.minimum(dense + width + self.margin, n), -1)
        at = np.flatnonzero(hit & (np.cumsum(mark[:-1]) > 0))
        slot = np.minimum(np.searchsorted(self.key, key[at]), len(self.key) - 1)
        sure = self.key[slot] == key[at]
        at, slot = at[sure], slot[sure]
        many = self.first[slot + 1] - self.first[slot]
        where = np.repeat(at, many)
        entry = np.arange(len(where)) + np.repeat(self.first[slot] - (np.cumsum(many) - many), many)
        item, diagonal = self.item[entry], where - self.place[entry]
        row = np.searchsorted(ends, where, "right")
        step = self.edits[item] + 1
        band = (diagonal + self.shift) // step
        pairs, rows_items = np.unique(row * len(self.items) + item, return_inverse=True)
        # group b holds the hits of bands b and b + 1: diagonals b (e + 1) to (b + 2) (e + 1) - 1
        group, count = _count(np.concatenate((rows_items, rows_items)), np.concatenate((band, band - 1)))
        own = pairs[group[0]] % len(self.items)
        found = set()
        for g, b, i in zip(pairs[group[0][ok := count >= self.least[own]]].tolist(), group[1][ok].tolist(), own[ok].tolist(), strict=True):
            found.add((g // len(self.items), i, b * int(self.edits[i] + 1) - self.shift))
        out: list[tuple[int, int, int, int, int]] = []
        begins = np.concatenate(([0], ends[:-1]))
        for r, i, low in sorted(found):
            e, size = int(self.edits[i]), int(self.size[i])
            a, b = max(int(begins[r]), low - e), min(int(ends[r]), low + 2 * (e + 1) + size + e)
            got = verify(self.items[i], data[a:b], e)
            if got:
                out.append((r, i, a + got[0], a + got[1], got[2]))
        return out


def settled(places: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping places (row, item, start, end, edits) of one row and item those with the fewest edits, then the
    first, then the shortest; in the order of row, item and start."""
    out: list[tuple[int, int, int, int, int]] = []
    kept: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for r, i, s, t, e in sorted(set(places), key=lambda m: (m[4], m[2], m[3])):
        own = kept.setdefault((r, i), [])
        at = bisect_left(own, (s, t, e))
        if (at == 0 or own[at - 1][1] <= s) and (at == len(own) or own[at][0] >= t):
            own.insert(at, (s, t, e))
    for (r, i), own in sorted(kept.items()):
        out += [(r, i, *place) for place in own]
    return out


def _count(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) and how often each is there."""
    key, count = np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_counts=True)
    return np.stack([key >> 32, key & 0xFFFFFFFF]), count


def banded(item: np.ndarray, region: np.ndarray, edits: int, free_start: bool) -> np.ndarray:
    """Edits of aligning all of ``item`` to a part of ``region`` that ends at each place (index: end).

    Only cells that a path of at most ``edits`` edits can reach are kept: with a fixed start a band of
    2 edits + 1 diagonals, with a free start those that the region is longer than the item, and edits more.
    """
    n, m = len(item), len(region)
    low, high = -edits, (m - n if free_start else 0) + edits
    width = high - low + 1
    far = n + m + 1
    diagonals = np.arange(width)
    j = diagonals + low  # column of row 0
    row = np.where((j >= 0) & (j <= m), 0 if free_start else j, far)
    padded = np.full(n + m + 2 * width + 2, -1, np.int16)
    padded[width : width + m] = region
    for i in range(1, n + 1):
        j = diagonals + low + i
        symbol = padded[width + low + i - 1 : width + low + i - 1 + width]
        new = row + (symbol != item[i - 1])
        new[(j < 1) | (j > m)] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if i + low <= 0 <= i + high:
            new[-(i + low)] = min(i, new[-(i + low)])
        new[(j < 0) | (j > m)] = far
        row = np.minimum.accumulate(new - diagonals) + diagonals
        row[(j < 0) | (j > m)] = far
    out = np.full(m + 1, far)
    j = diagonals + low + n
    ok = (j >= 0) & (j <= m)
    out[j[ok]] = row[ok]
    return out


def verify(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best part of the region, the first of the best; None beyond ``edits``."""
    at = region.tobytes().find(item.tobytes())
    if at >= 0:
        return at, at + len(item), 0
    if len(region) < len(item) - edits:
        return None
    ends = banded(item, region, edits, True)
    end = int(ends.argmin())
    least = int(ends[end])
    if least > edits:
        return None
    back = banded(item[::-1], region[:end][::-1], least, False)
    return end - int(np.flatnonzero(back == least)[0]), end, least


def _rows(index: Index, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) with byte places in the row's own text.

    A long row is searched in segments that overlap by more than any place and its surroundings, and its places are
    settled together: the segments leave no trace.
    """
    segment = max(SEGMENT, 4 * index.margin)
    for lo, hi in _text.chunks(offsets, SEGMENT):
        pieces = [normalise(raw[offsets[r] : offsets[r + 1]]) for r in range(lo, hi)]
        if hi - lo == 1 and len(pieces[0][0]) > 2 * segment:
            data, place = pieces[0]
            found: list[tuple] = []
            for a in range(0, len(data), segment):
                base = max(0, a - 2 * index.margin)
                part = data[base : a + segment]
                found += [(0, i, s + base, t + base, e) for _, i, s, t, e in index.matches(part, np.array([len(part)]))]
            for _, i, s, t, e in settled(found):
                yield lo, i, int(place[s]), int(place[t - 1]) + 1, e
            continue
        ends = np.cumsum([len(d) for d, _ in pieces])
        data = np.concatenate([d for d, _ in pieces])
        for r, i, s, t, e in settled(index.matches(data, ends)):
            base, place = int(ends[r]) - len(pieces[r][0]), pieces[r][1]
            yield lo + r, i, int(place[s - base]), int(place[t - base - 1]) + 1, e


FOUND = "doc_id long, item_id long, start long, end long, edits int"


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _text.utf8(batch.column(1))
            ids, out = batch.column(0), []
            chars = lambda a, b: int(np.count_nonzero((raw[a:b] & 0xC0) != 0x80))
            for r, i, s, t, e in _rows(index, raw, offsets):
                a = int(offsets[r])
                start = chars(a, a + s)
                out.append((ids[r].as_py(), index.ids[i], start, start + chars(a + s, a + t), e))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of at most about ITEM_BYTES of items each, in the order of a hash of the text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_BYTES))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield Index([tuple(r) for r in own.orderBy("item_id", "text").collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places where a document holds a benchmark item within its edit budget.

    One row per place: doc_id, item_id, start and end (characters of the text) and edits.  Of overlapping
    places of an item the one with the fewest edits, then the first, stays.  Null and empty texts and null items
    match nothing, nor do items under Q bytes; repeated rows and items report each; a null id is reported as
    null.  Other columns are ignored.  Without rows or items the result is empty.  Whole copies of items of any length
    are found at once; a damaged copy costs an alignment of the item's length times its edits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    out = None
    for index in indexes(benchmark):
        found = rows.mapInArrow(_text.lean(_scan(index)), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _clean(index: Index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _text.utf8(batch.column(at))
            leak = np.zeros(batch.num_rows, bool)
            for r, *_ in _rows(index, raw, offsets):
                leak[r] = True
            yield batch.filter(pa.array(~leak))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns of any name; rules as in find_leaks.

    Null and empty texts hold none and stay, and so do all rows where there are no items.
    """
    for index in indexes(benchmark):
        docs = docs.mapInArrow(_text.lean(_clean(index, docs.columns.index(text_col))), docs.schema)
    return docs
