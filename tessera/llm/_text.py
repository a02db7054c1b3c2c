"""Vectorised byte kernels: words, word hashes, shingles, sets (numpy only)."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
#: One odd 64-bit value per byte; a word's hash is their sum, each weighted by a number drawn for its place.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: White space of the word rule [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
CHUNK_BYTES = 1 << 20


def trim() -> None:
    """Give freed memory back to the system; a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, trimming after each input batch."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from run(fed())
        trim()

    return trimmed


def lean_group(run: Callable) -> Callable:
    """run, for applyInArrow on groups, trimming after each group."""

    def trimmed(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return trimmed


def lean_cogroup(run: Callable) -> Callable:
    """run, for applyInArrow on cogroups, trimming after each."""

    def trimmed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        trim()
        return out

    return trimmed


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """One odd 64-bit weight for each place, drawn from a counter and made on demand.

    Weights of unrelated places are unrelated, so that no pattern within words (as for powers of one number, the
    Thue-Morse sequence) makes their sums equal.
    """

    def __init__(self) -> None:
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            places = np.arange(1 << max(12, (n - 1).bit_length()), dtype=np.uint64)
            self.table = mix((places + U64(1)) * _STEP) | U64(1)
        return self.table


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _hash_runs(raw: np.ndarray, is_word: np.ndarray, starts: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = LOWER[raw[is_word]]
    first = np.cumsum(is_word, dtype=np.int64)[starts] - 1
    length = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept), dtype=np.int32) - np.repeat(first, length).astype(np.int32)
    value = BYTE_VALUE[kept]
    value *= powers.upto(int(length.max()) + 1)[place]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), length


def words(raw: np.ndarray, offsets: np.ndarray, powers: Powers, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows: hashes (A-Z lower-cased), the rows' offsets into them, first bytes and lengths.

    ``space`` marks the bytes between words.  Rows are cut there into pieces of CHUNK_BYTES, so memory follows
    the piece, not the row.
    """
    hashes, places, lengths, counts = [], [], [], np.zeros(len(offsets) - 1, np.int64)

    def add(piece: np.ndarray, begins: np.ndarray, is_word: np.ndarray, base: int) -> np.ndarray:
        starts = np.flatnonzero(begins)
        got, length = _hash_runs(piece, is_word, starts, powers)
        hashes.append(got)
        places.append(starts + base)
        lengths.append(length)
        return starts

    for lo, hi in chunks(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        while hi - lo == 1 and b - a > CHUNK_BYTES:
            end = a + CHUNK_BYTES
            while end < b and not space[raw[end]]:
                gap = np.flatnonzero(space[raw[end : end + CHUNK_BYTES]])
                end = end + int(gap[0]) if len(gap) else min(b, end + CHUNK_BYTES)
            is_word = ~space[raw[a:end]]
            begins = is_word.copy()
            begins[1:] &= ~is_word[:-1]
            counts[lo] += len(add(raw[a:end], begins, is_word, a))
            a = end
        is_word = ~space[raw[a:b]]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        rows = np.maximum(offsets[lo:hi] - a, 0)
        rows = rows[rows < b - a]
        begins[rows] = is_word[rows]
        starts = add(raw[a:b], begins, is_word, a)
        counts[lo:hi] += np.diff(np.searchsorted(starts, np.maximum(offsets[lo : hi + 1] - a, 0)))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(hashes, np.uint64), np.concatenate(([0], np.cumsum(counts))), join(places, np.int64), join(lengths, np.int64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, powers: Powers) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; with fewer words than ``width`` the whole sequence is one."""
    hashes, at, _, _ = words(raw, offsets, powers)
    weight = powers.upto(width + 2)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        if not n:
            yield hashes[:0]
            continue
        k = min(n, width)
        total = hashes[lo : hi - k + 1] * weight[1]
        for j in range(1, k):
            total = total + hashes[lo + j : hi - k + 1 + j] * weight[j + 1]
        grams = np.sort(mix(total + U64(k)))
        if len(grams) > 1:
            grams = grams[np.concatenate(([True], grams[1:] != grams[:-1]))]
        yield grams


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[r]:offsets[r+1]] for each r in rows, end to end, with the new offsets."""
    length = (offsets[1:] - offsets[:-1])[rows]
    out = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    index = np.arange(out[-1], dtype=np.int64)
    index += np.repeat(offsets[:-1][rows] - out[:-1], length)
    return values[index], out
