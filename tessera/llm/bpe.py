"""Byte-level BPE through a table of distinct words.

1. Every text is split into words by the GPT-2 rule on UTF-8 bytes.  Texts are taken in blocks of whole rows.  A
   block gives its positions in its own distinct words and, packed by bucket of their hash, those words.  Words are
   told apart by their bytes; a hash only finds them.
2. A bucket of the word table encodes each of its distinct words once, as the blocks' words stream by, and answers
   every block that asked.
3. A block's positions meet its answers: ids are joined back by position, pieces are joined to ids.

The split is made once and dealt by block; the word table reads it from there and the last step finds it in place.
A block's name holds a digest of its texts: should a lost part be read again from a source that gives other rows,
the query fails rather than join wrong positions.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _tables, _text

BLOCK_BYTES = 8 << 20
#: Distinct words, and their bytes, that a task of the word table holds; beyond, it forgets and encodes words anew.
WORDS_HELD, WORD_BYTES_HELD = 400_000, 32 << 20
LETTER, NUMBER, OTHER, SPACE, SPECIAL = 1, 2, 3, 4, 5
#: Code points above this and outside the tag range have no class of their own: they are OTHER.
LAST_CLASSED = 0x34000


class Vocabulary:
    """What a tokenizer file says: its text, character classes, pieces and special strings."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        tokenizer = Tokenizer.from_str(self.text)
        self.classes = self._classes(tokenizer)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
        added = tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        n = tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * n
        for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = piece.encode() if i in added else bytes(byte_of[c] for c in piece)

    @staticmethod
    def _classes(tokenizer) -> np.ndarray:
        """Class of each code point, asked of the tokenizer's own splitter."""
        classes = np.full(0x110000, OTHER, np.uint8)
        points = [c for c in range(LAST_CLASSED) if not 0xD800 <= c < 0xE000]
        for lo in range(0, len(points), 4096):
            part = points[lo : lo + 4096]
            # "!c" in one: OTHER; "ca" in one: LETTER; then "0c" in one: NUMBER; else SPACE
            text = "".join(f"a!{chr(c)}a0{chr(c)}" for c in part)
            ends = {b for _, (_, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
            for i, c in enumerate(part):
                at = 6 * i
                if at + 2 not in ends:
                    classes[c] = OTHER
                elif at + 3 not in ends:
                    classes[c] = LETTER
                else:
                    classes[c] = NUMBER if at + 5 not in ends else SPACE
        classes[0x20] = SPACE
        return classes


def byte_classes(raw: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    out = classes[raw.astype(np.intp)]
    high = np.flatnonzero(raw >= 0xC0)
    if len(high):
        lead = raw[high]
        for least, most, more, bits in ((0xC0, 0xDF, 1, 0x1F), (0xE0, 0xEF, 2, 0x0F), (0xF0, 0xFF, 3, 0x07)):
            at = high[(lead >= least) & (lead <= most)]
            if len(at):
                point = (raw[at] & bits).astype(np.intp)
                for j in range(1, more + 1):
                    point = point << 6 | (raw[at + j] & 0x3F)
                own = classes[point]
                for j in range(more + 1):
                    out[at + j] = own
    return out


def word_starts(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word of all rows, in order, and the class there; words cover all bytes.

    The rule: 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space+(?!non-space)|space+; special strings stand alone.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    kind = byte_classes(raw, classes)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if specials:
        data = raw.tobytes()
        for word in specials:
            at = data.find(word)
            while at >= 0:
                if not edge[at + 1 : at + len(word)].any():
                    kind[at : at + len(word)] = SPECIAL
                    edge[[at, at + len(word)]] = True
                at = data.find(word, at + len(word))
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= edge[:-1]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    space = kind[start] == SPACE
    open_space = space & ~edge[end]  # followed by other characters of the same row
    plain = open_space & (raw[end - 1] == 0x20)
    keep = np.ones(len(start), bool)
    keep[plain & (end - start == 1)] = False
    first = start.copy()
    after = np.flatnonzero(plain[:-1]) + 1
    first[after] -= 1
    last = end[open_space & ~plain] - 1
    while len(last) and (back := (raw[last] & 0xC0) == 0x80).any():
        last[back] -= 1
    more = [last]
    # contractions: a lone apostrophe, not joined to a space, and the letters after it
    quote = np.flatnonzero((end - start == 1) & (raw[start] == 0x27) & (kind[start] == OTHER) & (first == start))
    quote = quote[quote + 1 < len(start)]
    quote = quote[~edge[end[quote]] & (kind[start[np.minimum(quote + 1, len(start) - 1)]] == LETTER)]
    for q in quote.tolist():
        tail = raw[start[q + 1] : min(end[q + 1], start[q + 1] + 2)].tobytes()
        size = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
        if size:
            keep[q + 1] = False
            if start[q + 1] + size < end[q + 1]:
                more.append(np.array([start[q + 1] + size]))
    out = np.unique(np.concatenate([first[keep], *more]))
    return out, kind[out]


def _pack(values: bytes) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_unpack(packed), kind)


def _plain(vocabulary: Vocabulary) -> dict:
    """What workers need, as strings, bytes and arrays: executors need not know any class of this package."""
    size = [len(p) for p in vocabulary.pieces]
    return {
        "text": vocabulary.text,
        "classes": vocabulary.classes,
        "specials": [s.encode() for s in vocabulary.special],
        "pieces": np.frombuffer(b"".join(vocabulary.pieces), np.uint8),
        "piece_at": np.concatenate(([0], np.cumsum(size, dtype=np.int64))),
    }


def _split_block(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray, specials: list[bytes], powers: _text.Powers):
    """All words' hashes of a block, their first bytes, and words per row."""
    hashes, starts, counts = [], [], []
    for lo, hi in _text.chunks(offsets):
        a, b = offsets[lo], offsets[hi]
        part = raw[a:b]
        first, kind = word_starts(part, offsets[lo : hi + 1] - a, classes, specials)
        size = np.diff(np.append(first, len(part)))
        if len(first):
            place = np.arange(len(part), dtype=np.int32) - np.repeat(first, size).astype(np.int32)
            value = _text.BYTE_VALUE[part]
            value *= powers.upto(int(size.max()) + 1)[place]
            hashes.append(_text.mix(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(8) + kind))
        starts.append(first + a)
        counts.append(np.diff(np.searchsorted(first, offsets[lo : hi + 1] - a)))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(hashes, np.uint64), join(starts, np.int64), join(counts, np.int64)


def _distinct(raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number per place, how often) of the distinct words, compared byte by byte."""
    _, first, inverse, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    same = bool((sizes == sizes[first][inverse]).all())
    at, step = 0, 1 << 17
    while same and at < len(starts):
        own = slice(at, at + step)
        a, b = int(starts[at]), int(starts[own][-1] + sizes[own][-1])
        other = np.arange(a, b) + np.repeat(starts[first][inverse[own]] - starts[own], sizes[own])
        same = np.array_equal(raw[a:b], raw[other])
        at += step
    if not same:  # two words of one hash
        data, number = raw.tobytes(), {}
        inverse = np.array([number.setdefault(data[a : a + n], len(number)) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)], np.int64)
        _, first, often = np.unique(inverse, return_index=True, return_counts=True)
    return first, inverse, often


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches in tables of about BLOCK_BYTES."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


SPLIT = "block string, bucket int, one binary, two binary, three binary, ids array<long>"
SPLIT_ARROW = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _blocks(vocabulary, buckets: int):
    """Packed blocks.  Bucket -1: words per row, places of all words, buckets of the distinct words, ids of the
    rows; other buckets: sizes and bytes of the block's distinct words in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, number = _text.Powers(), 0
        own = vocabulary.value
        for table in _gathered(batches):
            raw_all, offsets_all = _text.utf8(table.column(1))
            ids, part = table.column(0).combine_chunks(), table.column(2)[0].as_py()
            del table
            for lo, hi in _text.chunks(offsets_all, BLOCK_BYTES):
                raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
                hashes, starts, counts = _split_block(raw, offsets, own["classes"], own["specials"], powers)
                sizes = np.diff(np.append(starts, len(raw)))
                first, inverse, often = _distinct(raw, hashes, starts, sizes)
                order = np.lexsort((first, -often))
                bucket = (hashes[first[order]] % np.uint64(buckets)).astype(np.int64)
                digest = hashlib.blake2b(np.ascontiguousarray(raw), digest_size=12)
                digest.update(offsets.tobytes())
                name = f"{part}:{number}:{digest.hexdigest()}"
                number += 1
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                place = rank[inverse]
                del hashes, inverse
                planes = b"".join((place >> np.uint32(shift) & np.uint32(255)).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24))
                rows = [(-1, _pack(counts.astype(np.int64).tobytes()), _pack(planes), _pack(bucket.astype(np.uint32).tobytes()), ids.slice(lo, hi - lo).to_pylist())]
                del place, planes
                by = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
                a = starts[first[order[by]]]
                size = sizes[first[order[by]]]
                text, at = _slices(raw, a, a + size)
                rows += [(i, _pack(size[x:y].astype(np.uint32).tobytes()), _pack(text[at[x] : at[y]].tobytes()), None, None) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SPLIT_ARROW.types[1:], strict=True))], schema=SPLIT_ARROW)

    return run


def _slices(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """raw[a[i]:b[i]] end to end, and the offsets."""
    size = b - a
    out = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    index = np.arange(out[-1], dtype=np.int64) + np.repeat(a - out[:-1], size)
    return raw[index], out


ANSWERS = "block string, bucket int, sizes binary, ids binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the split that ask the word table."""
    for batch in batches:
        for i in np.flatnonzero(batch.column(1).to_numpy() >= 0).tolist():
            yield pa.RecordBatch.from_arrays([c.slice(i, 1) for c in batch.columns[:4]], names=["block", "bucket", "sizes", "words"])


def _word_table(vocabulary):
    """Streams buckets: each distinct word is encoded once, then every block gets its words' ids in its own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = None
        number: dict[bytes, int] = {}
        held, ids, ends = 0, array("I"), array("q", [0])
        for batch in batches:
            if tokenizer is None:
                tokenizer = Tokenizer.from_str(vocabulary.value["text"])
                tokenizer.encode_special_tokens = False
            for r in range(batch.num_rows):
                block, bucket, sizes, words = (c[r].as_py() for c in batch.columns)
                if len(number) > WORDS_HELD or held > WORD_BYTES_HELD:
                    number, held, ids, ends = {}, 0, array("I"), array("q", [0])
                data, end = _unpack(words), np.cumsum(_numbers(sizes, np.uint32), dtype=np.int64).tolist()
                known = len(number)
                rows = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip([0, *end[:-1]], end, strict=True)], np.int64)
                new, at = np.sort(rows[rows >= known]), np.argsort(rows, kind="stable")
                at = at[len(rows) - len(new) :].tolist()  # a block's words are distinct: the new ones, in the order of their numbers
                held += len(data)
                for lo in range(0, len(at), 4096):
                    texts = [data[end[i - 1] if i else 0 : end[i]].decode() for i in at[lo : lo + 4096]]
                    for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                        own = e.ids
                        ids.extend(own)
                        ends.append(ends[-1] + len(own))
                values, out = _text.ragged(np.frombuffer(ids, np.uint32) if len(ids) else np.zeros(0, np.uint32), np.frombuffer(ends, np.int64), rows)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([_pack(np.diff(out).astype(np.uint32).tobytes())], pa.binary()), pa.array([_pack(values.tobytes())], pa.binary())], names=["block", "bucket", "sizes", "ids"])

    return run


def _assemble(vocabulary, digests: bool):
    said: list[np.ndarray] = []

    def run(split: pa.Table, answers: pa.Table) -> pa.Table:
        own = vocabulary.value
        pieces, piece_at = own["pieces"], own["piece_at"]
        if digests and not said:
            spelt = [f"{i},".encode() for i in range(len(piece_at) - 1)]
            said.extend((np.frombuffer(b"".join(spelt), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in spelt], dtype=np.int64)))))
        places = split.filter(pa.compute.equal(split.column("bucket"), -1))
        if places.num_rows != 1:
            raise RuntimeError("a block was split twice, or the word table answers one that was not: the texts were read again and differ")
        parts = {b: (s, v) for b, s, v in zip(*(answers.column(c).to_pylist() for c in ("bucket", "sizes", "ids")), strict=True)}
        bucket = _numbers(places.column("three")[0].as_py(), np.uint32)
        order = np.argsort(bucket, kind="stable")
        sizes = np.concatenate([_numbers(parts[b][0], np.uint32) for b in sorted(parts)]) if parts else np.zeros(0, np.uint32)
        if len(sizes) != len(bucket):
            raise RuntimeError("a block's positions and words differ: the texts were read again and differ")
        flat = np.concatenate([_numbers(parts[b][1], np.uint32) for b in sorted(parts)]) if parts else np.zeros(0, np.uint32)
        flat, word_at = _text.ragged(flat, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), np.argsort(order))
        planes = _numbers(places.column("two")[0].as_py(), np.uint8).reshape(4, -1)
        counts = _numbers(places.column("one")[0].as_py(), np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = places.column("ids")[0].as_py()
        del split, answers, places, parts
        out = []
        kinds = (pa.int64(), pa.int64(), *((pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.large_string())))
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        for lo, hi in _text.chunks(ends, 1 << 17):
            part = planes[:, ends[lo] : ends[hi]].astype(np.int64)
            tokens, token_at = _text.ragged(flat, word_at, part[0] | part[1] << 8 | part[2] << 16 | part[3] << 24)
            row_at = token_at[ends[lo : hi + 1] - ends[lo]]
            text, text_at = _text.ragged(pieces, piece_at, tokens.astype(np.int64))
            if digests:
                words, words_at = _text.ragged(*said, tokens.astype(np.int64))
            rows: list[tuple] = []
            for i in range(hi - lo):
                a, b = row_at[i], row_at[i + 1]
                decoded = text[text_at[a] : text_at[b]].tobytes().decode("utf-8", "replace")
                if digests:
                    listed = words[words_at[a] : max(words_at[a], words_at[b] - 1)].tobytes()
                    rows.append((ids[lo + i], int(b - a), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    rows.append((ids[lo + i], int(b - a), tokens[a:b].astype(np.int32), decoded))
            out.append(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names))
        out = pa.concat_tables(out)
        return out if digests else out.set_column(3, "decoded", out.column(3).cast(pa.string()))

    return run


def encode(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's token ids by the byte-level BPE file at ``path``, and the text that they decode to.

    One row per input row: doc_id, n_tokens, then ids and decoded, or with ``digests`` the SHA-256 of the ids
    joined by commas and of the decoded text.  Special strings of the file within a text become their ids, as
    the tokenizers library does.  Null and empty texts have no tokens and decode to "".  Repeated rows and
    ids and null ids are kept; other columns are ignored.  An empty table gives an empty result.

    The rows shuffled are at most one for each distinct word of a block of BLOCK_BYTES.
    """
    spark = docs.sparkSession
    _tables.small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(_plain(Vocabulary(path)))  # the file's size bounds it
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    split = rows.mapInArrow(_text.lean(_blocks(vocabulary, buckets)), SPLIT).repartition("block")
    asked = split.mapInArrow(_text.lean(_asked), "block string, bucket int, sizes binary, words binary")
    answers = asked.repartition("bucket").mapInArrow(_text.lean(_word_table(vocabulary)), ANSWERS)
    end = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return split.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_text.lean_cogroup(_assemble(vocabulary, digests)), f"doc_id long, n_tokens long, {end}")
