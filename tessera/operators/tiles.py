"""Products of all pairs of items over what they share, in tiles of two blocks of items: no pair enters a shuffle.
Sums of near items over what users like, in blocks of users: no candidate enters one.

Items are cut by id into blocks of about CELLS cells.  A user's list is sent to the tiles of those two blocks in
which the user has items, so it is copied once for each block that it touches.  A task holds one tile and takes its
items in runs of PRODUCTS products; what leaves it are finished pairs, or the nearest of each item in the tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import dropped, shuffles_removed, written

#: Cells of a block of items, cells that a task deals out at once, and products that it holds.
CELLS, DEALT, PRODUCTS = 2 << 20, 1 << 20, 1 << 20
#: Similarities are ranked as whole billionths.
SCALE = 1_000_000_000


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them all."""
    for kind in (np.int8, np.int16, np.int32):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind).tobytes()
    return x.astype(np.int64).tobytes()


def _wide(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, f"i{len(cell) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def _deal(bounds: list, fits: np.ndarray | None = None):
    """Rows (user, item, value, size), sorted by user and item, become cells by tile: a user's list is never parted.

    With ``fits`` the rows are sets: see _deal_sets.
    """
    if fits is not None:
        return _deal_sets(bounds, fits)
    blocks = len(bounds) + 1
    cut = np.array(bounds, np.int64)

    def dealt(user: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        block = np.searchsorted(cut, cells[:, 0], "right")
        start = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (block[1:] != block[:-1])])
        size = np.diff(np.r_[start, len(user)])
        owner, block, pairs = user[start], block[start], []
        for apart in range(len(start)):  # segments of one user that are so many places apart
            first = np.flatnonzero(owner[: len(owner) - apart] == owner[apart:])
            if not len(first):
                break
            pairs.append(np.stack([block[first] * blocks + block[first + apart], first, first + apart]))
        tile, one, two = np.concatenate(pairs, axis=1)
        order = np.argsort(tile, kind="stable")
        tile, one, two = tile[order], one[order], two[order]
        edge = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
        rows: list[list] = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            row: list = [int(tile[lo]), int(hi - lo)]
            for side in (one[lo:hi], two[lo:hi]) if one[lo] != two[lo] else (one[lo:hi],):
                own = cells[_ranges(start[side], size[side])]
                row += [_small(size[side]), len(own), *(_small(own[:, c]) for c in range(3))]
            rows.append(row + [None] * (12 - len(row)))
        kinds = [pa.int64(), pa.int64(), *[pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=TILE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, users, held = None, 0, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            new = np.ones(len(key), bool)
            new[0] = last is None or key[0] != last
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            user, last = number + np.cumsum(new), key[len(key) - 1]
            number = int(user[-1])
            users.append(user)
            held.append(np.stack([batch.column(c).to_numpy() for c in (1, 2, 3)], axis=1))
            if sum(map(len, users)) >= DEALT and users[0][0] != number:
                user, cells = np.concatenate(users), np.concatenate(held)
                whole = int(np.searchsorted(user, number))
                yield dealt(user[:whole], cells[:whole])
                users, held = [user[whole:]], [cells[whole:]]
        if users:
            yield dealt(np.concatenate(users), np.concatenate(held))

    return run


TILE = "tile long, users long, " + ", ".join(f"{s}_lists binary, {s}_n long, {s}_items binary, {s}_values binary, {s}_sizes binary" for s in "lr")
TILE_NAMES = [x.split()[0] for x in TILE.split(", ")]


def _side(rows: list[tuple], at: int) -> tuple[np.ndarray, ...]:
    """(user of each cell, place of its item, value, items, size of each item) of one side of a tile."""
    lists = np.concatenate([_wide(r[at], r[1]) for r in rows])
    item, value, size = (np.concatenate([_wide(r[at + k], r[at + 1]) for r in rows]) for k in (2, 3, 4))
    items, first, place = np.unique(item, return_index=True, return_inverse=True)
    return np.repeat(np.arange(len(lists)), lists), place, value, items, size[first]


def _sums(left: tuple, right: tuple, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in left, place in right, sum of products), by runs of left's items; with ``upper`` the right is the greater."""
    user, place, value, items, _ = left
    other_user, other, other_value, others, _ = right
    total = int(max(user[-1], other_user[-1])) + 1
    start = np.searchsorted(other_user, np.arange(total + 1))
    order = np.argsort(place, kind="stable")
    user, place, value = user[order], place[order], value[order]
    size = start[user + 1] - start[user]
    done = np.r_[0, np.cumsum(size)]
    end = np.r_[np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]  # behind each item's cells
    width, upto, lo = np.int64(len(others)), done[end], 0
    while lo < len(place):
        hi = end[max(np.searchsorted(upto, done[lo] + PRODUCTS, "right") - 1, np.searchsorted(end, lo, "right"))]
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = lo
        while at < hi:  # an item of very many products is taken in parts
            to = min(hi, max(at + 1, int(np.searchsorted(done, done[at] + PRODUCTS, "right")) - 1))
            cells = _ranges(start[user[at:to]], size[at:to])
            key = np.repeat(place[at:to], size[at:to]) * width + other[cells]
            product = np.repeat(value[at:to], size[at:to]) * other_value[cells]
            if upper:
                keep = others[other[cells]] > np.repeat(items[place[at:to]], size[at:to])
                key, product = key[keep], product[keep]
            keys, product = np.concatenate([keys, key]), np.concatenate([sums, product])
            by = np.argsort(keys)
            keys, product = keys[by], product[by]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            keys, sums = keys[new], np.add.reduceat(product, new) if len(new) else product
            at = to
        if len(keys):
            yield keys // width, keys % width, sums
        lo = hi


def _rounded(x: np.ndarray) -> np.ndarray:
    """Half up, as Spark and SQL round."""
    low = np.floor(x)
    return (low + (x - low >= 0.5)).astype(np.int64)


def _similar(kind: str, both: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    if kind == "cosine":
        return both / np.sqrt(one.astype(np.float64) * two.astype(np.float64))
    return both / (one + two - both)


def _products(kind: str, top: int):
    """Streams tiles sorted by number; memory holds one."""

    def pairs(left: tuple, right: tuple, upper: bool) -> Iterator[pa.RecordBatch]:
        for x, y, both in _sums(left, right, upper):
            sim = _similar(kind, both, left[4][x], right[4][y])
            if top:
                near = _rounded(sim * SCALE)
                if (own := left[3][x] == right[3][y]).any():
                    x, y, sim, near = x[~own], y[~own], sim[~own], near[~own]
                if not len(x):
                    continue
                order = np.argsort((x - x[0]) << 32 | (SCALE + 1 - near), kind="stable")  # y rises before
                run = x[order]
                first = np.maximum.accumulate(np.where(np.r_[True, run[1:] != run[:-1]], np.arange(len(run)), 0))
                order = order[np.arange(len(run)) - first < top]
                x, y, sim, near = x[order], y[order], sim[order], near[order]
                yield pa.RecordBatch.from_arrays([pa.array(left[3][x]), pa.array(right[3][y]), pa.array(sim), pa.array(near)], names=["a", "b", "sim", "simq"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(left[3][x]), pa.array(right[3][y]), pa.array(both), pa.array(sim)], names=["a", "b", "both", "sim"])

    def tile(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        left = _side(rows, 2)
        if rows[0][7] is None:
            yield from pairs(left, left, not top)
            return
        right = _side(rows, 7)
        yield from pairs(left, right, False)
        if top:
            yield from pairs(right, left, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield from tile(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from tile(rows)

    return run


def _blocks(cells: DataFrame, key: str, most: int) -> tuple[int, list[int]]:
    """(blocks, least keys of all but the first) of ranges of the key with about ``most`` rows each."""
    blocks = max(1, -(-cells.count() // most))
    shares = [i / blocks for i in range(1, blocks)]
    bounds = cells.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), 20 * blocks)).first()[0] if shares else []
    return blocks, sorted(set(bounds or []))


def products(cells: DataFrame, kind: str, top: int = 0) -> DataFrame:
    """Of cells (user, item, value), all whole numbers but the user: (a, b, both, sim) of every two items a < b that
    share a user, where ``both`` sums the products of their values.

    ``kind`` is cosine (value as rating) or jaccard (value 1).  With ``top``: (a, b, sim, simq), both ways, with at
    least the ``top`` most similar b of each a, ties to the least b.  Cells without user or item go.  Repeated cells count each.
    """
    if dict(cells.dtypes)[cells.columns[1]] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"items must be whole numbers: {cells.schema[1].simpleString()}")
    cells = written(cells.toDF("user", "item", "value").where("user is not null and item is not null and value is not null"), "cells")
    size = cells.groupBy("item").agg(F.sum(F.col("value") * F.col("value")).alias("size"))
    blocks, bounds = _blocks(cells, "item", CELLS)
    rows = cells.join(size, "item").select("user", F.col("item").cast("long"), F.col("value").cast("long"), F.col("size").cast("long"))
    rows = rows.repartition("user").sortWithinPartitions("user", "item")
    dealt = rows.mapInArrow(_deal(bounds), TILE)
    dealt = dealt.repartition(2 * blocks, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_products(kind, top), "a long, b long, sim double, simq long" if top else "a long, b long, both long, sim double")


# Sets of tokens: pairs of a Jaccard similarity.  A token is its 64-bit hash; in a tile, a part of that.

#: log2 of the places of the table that orders tokens, and bits of a token's name in a tile.
ORDER_BITS, NAME_BITS = 21, 24
#: Sets on the right that are counted at once, cells of the counts, and tokens of a block of sets that are verified.
SUB, COUNTS, VERIFIED = 8192, 1 << 20, 4 << 20
#: Below this threshold most tokens are first ones, and parities tell little: tiles get whole sets.
WHOLE_BELOW = 0.4


def _cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all 64-bit words, edges of the cells) of a binary column without nulls."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), np.uint64), (edges - edges[0]) // 8


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, hashes) -> (item, n, h, s): the distinct ones in order, their number and digest; empty sets go."""
    for batch in batches:
        lists = batch.column(1)
        edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [np.unique(values[lo:hi].view(np.uint64)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        rows = [i for i, x in enumerate(sets) if len(x)]
        cells = [sets[i].tobytes() for i in rows]
        names = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in cells], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([len(x) // 8 for x in cells], pa.int64()), names, pa.array(cells, pa.binary())], names=["item", "n", "h", "s"])


def hashed_sets(sets: DataFrame, item: str, token: str) -> DataFrame:
    """(item, n, h, s), written: the set of each item's tokens as sorted 64-bit hashes, its size and a digest.

    ``token`` is a token a row or an array of them; arrays of one item are put together.  Null items and tokens go.
    """
    rows = sets.select(F.col(item).alias("item"), F.col(token).alias("token")).where("item is not null")
    whole = dict(rows.dtypes)["token"].startswith("array")
    if whole:
        rows = rows.select("item", F.transform(F.filter(F.coalesce("token", F.array()), lambda x: x.isNotNull()), lambda x: F.xxhash64(x)).alias("l"))
    else:
        rows = rows.where("token is not null").groupBy("item").agg(F.collect_list(F.xxhash64("token")).alias("l"))
    kinds = f"item {rows.schema['item'].dataType.simpleString()}, n long, h binary, s binary"
    out = written(rows.mapInArrow(_hash_sets, kinds), "sets")
    count, different = out.agg(F.count("item"), F.countDistinct("item")).first()
    if whole and count != different:
        dropped(out)
        out = written(rows.groupBy("item").agg(F.flatten(F.collect_list("l")).alias("l")).mapInArrow(_hash_sets, kinds), "sets")
    return out


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << ORDER_BITS, np.int32)
    for batch in batches:
        total += np.bincount((_cells_of(batch.column(0))[0] >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total)).astype(np.int32)
    parts = total.reshape(64, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
    level = (8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "counts"])


def _sketch_bits(n: np.ndarray) -> np.ndarray:
    return np.maximum(64, np.exp2(np.ceil(np.log2(2.0 * n)))).astype(np.int64)


def _prefix_length(n, threshold: float):
    return (n - np.ceil(n * threshold - 1e-9) + 1).astype(np.int64)


def _first_tokens(shared, threshold: float):
    """(item, n, h, s) -> (item, n, h, prefix, sketch): the names of the first tokens in the order of the table, rare
    ones before, and the parity of all tokens in about 2 to 4 bits for each; below WHOLE_BELOW the names of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            words, edges = _cells_of(batch.column(3))
            sizes = batch.column(1).to_numpy()
            first, bits = _prefix_length(sizes, threshold), _sketch_bits(sizes)
            level = levels[(words >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
            prefixes, sketches = [], []
            for i in range(len(sizes)):
                own = words[edges[i] : edges[i + 1]]
                order = np.argsort(level[edges[i] : edges[i + 1]], kind="stable")  # hashes rise before
                if threshold < WHOLE_BELOW:
                    prefixes.append(own[order].astype(np.uint32).tobytes())
                    sketches.append(b"")
                    continue
                prefixes.append(own[order[: first[i]]].astype(np.uint32).tobytes())
                odd = np.bincount((own & np.uint64(bits[i] - 1)).astype(np.int64), minlength=bits[i]) & 1
                sketches.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary())], names=["item", "n", "h", "prefix", "sketch"])

    return run


def named(item: str, kind: str):
    """A whole number for an item: itself, or a hash of 64 bits."""
    return F.col(item).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(item)


def kinds_of_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, x, y, n, class, prefix, sketch), written: equal sets are one, named by their least item; class by size."""
    spark = sets.sparkSession
    with shuffles_removed(spark):
        parts = sets.select("s").coalesce(12).mapInArrow(_token_counts, "part int, counts binary").groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()
    table = np.zeros((64, (1 << ORDER_BITS) // 64), np.uint8)
    for r in parts:
        table[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    shared = spark.sparkContext.broadcast(table.ravel())
    kind = dict(sets.dtypes)["item"]
    rows = sets.mapInArrow(_first_tokens(shared, threshold), f"item {kind}, n long, h binary, prefix binary, sketch binary")
    rows = rows.groupBy("h").agg(F.min("item").alias("x"), *(F.first(c).alias(c) for c in ("n", "prefix", "sketch")))
    rows = written(rows.select("h", "x", named("x", kind).alias("y"), "n", F.floor(F.log2("n") * 32).cast("int").alias("class"), "prefix", "sketch"), "kinds")
    shared.destroy()
    return rows


SETS_TILE = "tile long, side int, ids binary, sizes binary, prefixes binary, sketches binary"


def _deal_sets(places: list[tuple[int, int, int]], fits: np.ndarray):
    """Rows (y, n, class, prefix, sketch) -> packed rows of SETS_TILE, for each tile of two blocks that ``fits`` allows.

    ``places``: (class, its first block, blocks that it is dealt over)."""
    blocks, at = len(fits), np.array(sorted(places), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            _, first, parts = at[np.searchsorted(at[:, 0], batch.column(2).to_numpy())].T
            block = first + ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)) % parts
            prefix, sketch = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for b in np.unique(block).tolist():
                own = np.flatnonzero(block == b)
                row = [ids[own].tobytes(), sizes[own].astype(np.int64).tobytes(), b"".join([prefix[i] for i in own]), b"".join([sketch[i] for i in own])]
                others = np.flatnonzero(fits[b]).tolist()
                columns = [pa.array([min(b, o) * blocks + max(b, o) for o in others], pa.int64()), pa.array([int(b > o) for o in others], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x] * len(others), pa.binary()) for x in row], names=[x.split()[0] for x in SETS_TILE.split(", ")])

    return run


class _Sets:
    """One side of a tile of sets, by rising size."""

    def __init__(self, rows: list[tuple], threshold: float) -> None:
        ids, n, tokens, bits = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((2, np.int64), (3, np.int64), (4, np.uint32), (5, np.uint64)))
        size = _prefix_length(n, threshold)
        words = _sketch_bits(n) // 64
        order = np.argsort(n, kind="stable")
        self.ids, self.n = ids[order], n[order]
        self.edges = np.r_[0, np.cumsum(size[order])]
        held = n if threshold < WHOLE_BELOW else size
        self.all = (tokens & np.uint32((1 << NAME_BITS) - 1)).astype(np.int32)
        self.start = (np.cumsum(held) - held)[order]
        self.names = self.all[_ranges(self.start, size[order])]
        self.words, self.bits, self.at = words[order], bits, (np.cumsum(words) - words)[order]

    def sketches(self, rows: np.ndarray, width: int, own: int) -> np.ndarray:
        """Sketches of ``own`` words, folded to ``width``."""
        whole = self.bits[self.at[rows][:, None] + np.arange(own)]
        return np.bitwise_xor.reduce(whole.reshape(len(rows), own // width, width), axis=1)


def _differ(left: _Sets, right: _Sets, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least number of tokens that are in one of two sets only, by their sketches."""
    out = np.zeros(len(x), np.int64)
    kind = left.words[x] << 32 | right.words[y]
    for k in np.unique(kind).tolist():
        one, two, at = k >> 32, k & 0xFFFFFFFF, np.flatnonzero(kind == k)
        width = min(one, two)
        step = max(1, COUNTS // max(one, two))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            both = left.sketches(x[part], width, one) ^ right.sketches(y[part], width, two)
            out[part] = np.bitwise_count(both).sum(axis=1)
    return out


def _overlap(left: _Sets, right: _Sets, x: np.ndarray, y: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Names that whole sets have in common, by rising x; ``mark`` has a place for each name and is left as it was."""
    out = np.zeros(len(x), np.int64)
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if len(x) else ():
        own = left.all[left.start[x[lo]] : left.start[x[lo]] + left.n[x[lo]]]
        mark[own] = 1
        step = max(1, COUNTS // int(right.n[y[lo:hi]].max()))
        for at in range(lo, hi, step):
            rows = y[at : min(hi, at + step)]
            size = right.n[rows]
            out[at : at + len(rows)] = np.add.reduceat(mark[right.all[_ranges(right.start[rows], size)]], np.cumsum(size) - size, dtype=np.int64)
        mark[own] = 0
    return out


def _near_sets(left: _Sets, right: _Sets, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of sets that can reach the threshold by sizes, tokens that the prefixes share and sketches.

    The set whose first tokens end earlier shares nothing more but among its last ceil(t n) - 1.
    """
    share, table = threshold / (1 + threshold), np.zeros(1 << NAME_BITS, np.int32)
    mark = np.zeros(1 << NAME_BITS, np.int8)
    for lo in range(0, len(right.n), SUB):
        hi = min(len(right.n), lo + SUB)
        least, most = right.n[lo], right.n[hi - 1]
        begin = int(np.searchsorted(left.n, least * threshold - 1e-6))
        end = int(np.searchsorted(left.n, most / threshold + 1e-6, "right"))
        end = min(end, hi) if same else end
        if begin >= end:
            continue
        own = right.names[right.edges[lo] : right.edges[hi]]
        order = np.argsort(own, kind="stable")
        doc = np.repeat(np.arange(hi - lo), np.diff(right.edges[lo : hi + 1]))[order]
        known, first, count = np.unique(own[order], return_index=True, return_counts=True)
        table[known] = np.arange(1, len(known) + 1)
        place = table[left.names[left.edges[begin] : left.edges[end]]]
        table[known] = 0
        used = np.flatnonzero(place)
        place = place[used] - 1
        row = np.searchsorted(used, left.edges[begin : end + 1] - left.edges[begin])  # cells of each set on the left
        start, size = first[place], count[place]
        done = np.r_[0, np.cumsum(size)]
        width, at, rows = hi - lo, 0, end - begin
        while at < rows:
            to = int(np.searchsorted(done[row], done[row[at]] + 4 * PRODUCTS, "right")) - 1
            to = min(rows, max(at + 1, min(to, at + max(1, COUNTS // width))))
            cells = slice(row[at], row[to])
            key = np.repeat(np.repeat(np.arange(to - at) * width, np.diff(row[at : to + 1])), size[cells])
            key += doc[_ranges(start[cells], size[cells])]
            both = np.bincount(key, minlength=(to - at) * width)
            some = share * min(left.n[begin + at] - threshold * most, least - threshold * left.n[begin + to - 1])
            found = np.flatnonzero(both >= max(1, np.ceil(some - 1e-6)))
            x, y, both = begin + at + found // width, lo + found % width, both[found]
            one, two = left.n[x], right.n[y]
            keep = (one >= two * threshold - 1e-9) & (two >= one * threshold - 1e-9)
            keep &= both + np.ceil(np.maximum(one, two) * threshold - 1e-9) - 1 >= share * (one + two) - 1e-6
            if same:
                keep &= x < y
            x, y = x[keep], y[keep]
            most_shared = _overlap(left, right, x, y, mark) if threshold < WHOLE_BELOW else (left.n[x] + right.n[y] - _differ(left, right, x, y)) / 2
            keep = most_shared >= share * (left.n[x] + right.n[y]) - 1e-6
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(left.ids[x[keep]]), pa.array(right.ids[y[keep]])], names=["a", "b"])
            at = to


def _set_tiles(threshold: float):
    """Streams rows sorted by tile; memory holds one."""

    def tile(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r[1] == k] for k in (0, 1)]
        same = not rows[0][0][1]
        rows.clear()
        if sides[0] and (same or sides[1]):
            left = _Sets(sides[0], threshold)
            sides[0].clear()
            yield from _near_sets(left, left if same else _Sets(sides[1], threshold), same, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0][0] != row[0]:
                    yield from tile(rows)
                    rows = []
                rows.append(((row[0], row[-1]), *row[1:-1]))
        if rows:
            yield from tile(rows)

    return run


def prefix_pairs(kinds: DataFrame, threshold: float) -> DataFrame:
    """(a, b), once each, of names y of kinds_of_sets that can have a Jaccard similarity of ``threshold``.

    Sets are cut into blocks by size; blocks whose sizes cannot reach the threshold never meet.  A set's first tokens are
    copied once for each block that its own meets.
    """
    first = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    classes = kinds.groupBy("class").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum(first).alias("cells")).orderBy("class").collect()
    total = sum(r["cells"] for r in classes)
    blocks = max(-(-total // (8 * CELLS)), min(6, -(-2 * total // CELLS)), 1)
    each, places, ranges = -(-total // blocks), [], []
    held = 0
    for r in classes:
        if ranges and held + r["cells"] <= 1.2 * each:
            held += r["cells"]
            ranges[-1] = (ranges[-1][0], r["most"])
            places.append((r["class"], len(ranges) - 1, 1))
        else:
            parts = max(1, round(r["cells"] / each))
            places.append((r["class"], len(ranges), parts))
            ranges += [(r["least"], r["most"])] * parts
            held = r["cells"] if parts == 1 else 2 * each
    least, most = np.array(ranges or [(0, 0)], np.float64).T
    reach = most[:, None] >= least[None] * threshold - 1e-9
    fits = reach & reach.T
    dealt = kinds.select("y", "n", "class", "prefix", "sketch").mapInArrow(_deal(places, fits), SETS_TILE)
    apart = (F.floor(F.col("tile") / len(fits)) != F.col("tile") % len(fits)).cast("int").alias("apart")
    dealt = dealt.select("*", apart).repartition(max(2 * len(fits), int(fits.sum())), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_set_tiles(threshold), "a long, b long")


def _shared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """(a, b, shared, na, nb) of a tile's pairs (a, b), from its sets (y, s)."""
    kinds = [pa.int64()] * 5
    if not pairs.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=["a", "b", "shared", "na", "nb"])
    column = sets.column("s").combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    words, edges = _cells_of(column)
    known = np.unique(words)
    code = np.searchsorted(known, words).astype(np.int32)
    ids = sets.column("y").to_numpy()
    by = np.argsort(ids)
    a, b = (pairs.column(c).to_numpy() for c in "ab")
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    one, two = (by[np.searchsorted(ids, x, sorter=by)] for x in (a, b))
    size = np.diff(edges).astype(np.int64)
    shared, mark = np.zeros(len(a), np.int64), np.zeros(len(known), np.int8)
    cut = np.flatnonzero(np.r_[True, one[1:] != one[:-1], True])
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = code[edges[one[lo]] : edges[one[lo] + 1]]
        mark[own] = 1
        step = max(1, COUNTS // int(size[two[lo:hi]].max()))
        for at in range(lo, hi, step):
            rows = two[at : min(hi, at + step)]
            cells = mark[code[_ranges(edges[rows].astype(np.int64), size[rows])]]
            shared[at : at + len(rows)] = np.add.reduceat(cells, np.cumsum(size[rows]) - size[rows], dtype=np.int64)
        mark[own] = 0
    return pa.table([pa.array(x, pa.int64()) for x in (a, b, shared, size[one], size[two])], names=["a", "b", "shared", "na", "nb"])


def verified_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, na, nb) of pairs of names, from hashed_sets: tokens in common and sizes, by whole sets.

    Sets are dealt into blocks; one is sent to those pairs of blocks only in which it has a pair.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(3, -(-total // VERIFIED))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = written(pairs.withColumn("tile", F.least(home("a"), home("b")) * blocks + F.greatest(home("a"), home("b"))), "pairs")
    asked = written(pairs.select("tile", F.explode(F.array("a", "b")).alias("y")).distinct(), "asked")
    rows = sets.select(named("item", dict(sets.dtypes)["item"]).alias("y"), "s")
    asked = F.broadcast(asked) if asked.count() <= 1 << 20 else asked
    rows = rows.join(asked, "y").select("tile", "y", "s")
    return pairs.groupBy("tile").cogroup(rows.groupBy("tile")).applyInArrow(lambda p, s: _shared(p, s), "a long, b long, shared long, na long, nb long")


def _block_of(bounds: list[int]):
    cut = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(cut, batch.column(0).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    return run


def _best(top: int):
    """The ``top`` unseen items of each user of a block by the sum over liked items' lists, in runs of PRODUCTS sums."""

    def run(cells: pa.Table, lists: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if lists.num_rows and cells.num_rows:
            user, item, liked = (cells.column(c).to_numpy() for c in ("user", "item", "liked"))
            order = np.argsort(user, kind="stable")
            user, item, liked = user[order], item[order], liked[order]
            known = lists.column("item").to_numpy()
            by = np.argsort(known)
            near, simq = (lists.column(c).combine_chunks() for c in ("near", "simq"))
            sizes = np.diff(near.offsets.to_numpy())
            start, known, sizes = near.offsets.to_numpy()[:-1][by] - near.offsets.to_numpy()[0], known[by], sizes[by]
            near, simq = near.flatten().to_numpy(), simq.flatten().to_numpy()
            names, code = np.unique(np.r_[near, item], return_inverse=True)
            near, seen = code[: len(near)], code[len(near) :]
            at = np.minimum(np.searchsorted(known, item), len(known) - 1)
            size = np.where((liked == 1) & (known[at] == item), sizes[at], 0)
            edge = np.flatnonzero(np.r_[True, user[1:] != user[:-1], True])
            number = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            done, width, lo = np.r_[0, np.cumsum(size)], np.int64(len(names)), 0
            while lo < len(edge) - 1:
                hi = max(lo + 1, int(np.searchsorted(done[edge], done[edge[lo]] + PRODUCTS, "right")) - 1)
                own = slice(edge[lo], edge[hi])
                cells_of = _ranges(start[at[own]], size[own])
                key = np.repeat(number[own], size[own]) * width + near[cells_of]
                order = np.argsort(key)
                key, score = key[order], simq[cells_of][order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                key, score = key[new], np.add.reduceat(score, new) if len(new) else score
                fresh = ~np.isin(key, number[own] * width + seen[own])
                key, score = key[fresh], score[fresh]
                who = key // width
                order = np.lexsort((-score, who))  # items rise before
                who, key, score = who[order], key[order], score[order]
                first = np.maximum.accumulate(np.where(np.r_[True, who[1:] != who[:-1]], np.arange(len(who)), 0)) if len(who) else who
                rank = np.arange(len(who)) - first + 1
                keep = rank <= top
                out.append((user[edge[who[keep]]], names[key[keep] % width], score[keep], rank[keep]))
                lo = hi
        return pa.table([pa.array(np.concatenate([x[i] for x in out]) if out else [], pa.int64()) for i in range(4)], names=["user_id", "item_id", "scoreq", "rank"])

    return run


def best_sums(likes: DataFrame, near: DataFrame, seen: DataFrame, top: int) -> DataFrame:
    """(user_id, item_id, scoreq, rank): of each user's items b, near (a, b, simq) to liked ones a and not seen, the ``top``
    with the largest sums of simq, ties to the least item.

    A block of users meets the lists of just the items that they like; a list is copied once for each such block.
    """
    rows = seen.select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.lit(0).cast("long").alias("liked"))
    rows = rows.unionByName(likes.select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.lit(1).cast("long").alias("liked")))
    rows = rows.where("user is not null and item is not null")
    kinds = "user long, item long, liked long"
    blocks, bounds = _blocks(rows, "user", CELLS // 2)
    rows = rows.select(*(F.col(c).cast("long") for c in ("user", "item", "liked"))).mapInArrow(_block_of(bounds), f"block long, {kinds}")
    rows = written(rows, "cells")
    lists = near.groupBy(F.col("a").alias("item")).agg(F.collect_list(F.struct("b", "simq")).alias("l")).select("item", F.col("l.b").alias("near"), F.col("l.simq").alias("simq"))
    asked = rows.where("liked = 1").select(F.col("block").alias("asked_by"), F.col("item").alias("thing")).distinct()
    asked = asked.join(lists, F.col("thing") == F.col("item")).select("asked_by", "item", "near", "simq")
    return rows.groupBy("block").cogroup(asked.groupBy("asked_by")).applyInArrow(_best(top), "user_id long, item_id long, scoreq long, rank long")
