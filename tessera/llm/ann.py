"""Approximate nearest neighbours: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _tables, _text

#: Bound of the sample that the centroids are fitted on.
SAMPLE = 20_000
#: Most centroids of a half: lists grow with the table up to MOST_CENTROIDS**2, whose sizes reach the driver.
MOST_CENTROIDS = 512
ENTRIES_PER_LIST = 64
#: Entries of a block, and probes that meet a copy of it at once.
BLOCK, QUERY_BLOCK = 16_384, 16_384


def kmeans(x: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm; an empty centroid keeps its place."""
    k = min(k, len(x))
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _square(x, centre).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)


def multi_sequence(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Lists i * len(second) + j by rising first[i] + second[j] until they hold ``wanted`` entries.

    A heap holds the border of the pairs taken so far (Babenko and Lempitsky, 2012).  Empty lists are passed.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())], names=["vec_id", "vec"])

    return run


def _assign(centres: tuple[np.ndarray, np.ndarray], width: int):
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            cell = _square(x[:, :half], centres[0]).argmin(axis=1) * len(centres[1]) + _square(x[:, half:], centres[1]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "vec", "cell"])

    return run


def _place(cell: np.ndarray, part: np.ndarray, blocks: int) -> np.ndarray:
    return (_text.mix(cell.astype(np.uint64) * np.uint64(0x10001) + part.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def _entries(sizes: np.ndarray, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            parts = -(-sizes[cell] // BLOCK)
            part = _text.mix(batch.column(0).to_numpy().astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_place(cell, part, blocks)), batch.column(0), batch.column(1), batch.column(2)], names=["block", "vec_id", "vec", "cell"])

    return run


def _probes(centres: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, blocks: int, wanted: int, width: int):
    """One row for each query and block that holds a list it visits."""
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            one, two = _square(x[:, :half], centres[0]), _square(x[:, half:], centres[1])
            out = []
            for i, query in enumerate(batch.column(0).to_pylist()):
                cells = np.array(multi_sequence(one[i], two[i], sizes, wanted), np.int64)
                if not len(cells):
                    continue
                parts = -(-sizes[cells] // BLOCK)
                own = np.repeat(cells, parts)
                place = _place(own, np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts), blocks)
                for block in np.unique(place):
                    out.append((int(block), query, x[i].tobytes(), np.unique(own[place == block]).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "query_id", "query", "cells"])

    return run


def _rerank(k: int, width: int, lists: int):
    def run(entries: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if entries.num_rows and probes.num_rows:
            ids = entries.column("vec_id").to_numpy()
            x = _matrix(entries.column("vec").combine_chunks(), width)
            cell = entries.column("cell").to_numpy()
            norms = (x * x).sum(axis=1)
            for query, packed, cells in zip(probes.column("query_id").to_pylist(), probes.column("query").to_pylist(), probes.column("cells").to_pylist(), strict=True):
                q = np.frombuffer(packed, np.float64)
                visited = np.zeros(lists, bool)
                visited[np.frombuffer(cells, np.int32)] = True
                rows = np.flatnonzero(visited[cell] & (ids != query))
                if not len(rows):
                    continue
                near = norms[rows] - 2 * (x[rows] @ q)
                if len(rows) > k:  # all that could be among the k nearest, rounding allowed for; then exactly
                    edge = np.partition(near, k - 1)[k - 1]
                    rows = rows[near <= edge + 1e-9 * (1 + abs(edge) + float(q @ q))]
                exact = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
                for i in np.lexsort((ids[rows], exact))[:k]:
                    out.append((query, int(ids[rows[i]]), float(exact[i])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, share: float = 0.7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row by Euclidean distance: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on vec_id.  Every row is indexed; a query never finds rows of its own id.
    Each query visits lists in the order of summed centroid distances until they hold ``share`` of all rows
    (at least 20 k); share 1 is exact.  It is sent to the blocks of those lists only, and a block is copied once for
    QUERY_BLOCK probes of it: what is shuffled follows the lists visited.  Scores are in double precision on the original vectors; ties go to the
    smaller id.  Rows with a null id, or whose vector is null, zero, of another width than most, or has null
    or non-finite components take no part.  Of query rows with the same id the least vector asks; as
    candidates, repeated rows count each.  Other columns are ignored; an empty table gives an empty result.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where("vec_id is not null and v is not null")
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widths is None or not widths["n"]:
        return spark.createDataFrame([], schema)
    width = widths["n"]
    sound = "size(v) = {} and forall(v, x -> coalesce(x = x and not isnan(x) and abs(x) < double('Infinity'), false)) and exists(v, x -> x <> 0)".format(width)
    packed = rows.where(sound).mapInArrow(_pack(width), "vec_id long, vec binary")
    packed = _tables.written(packed, "vectors")
    total = packed.count()
    if not total:
        return spark.createDataFrame([], schema)
    few = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < -(-(SAMPLE << 20) // total)).orderBy(F.xxhash64("vec_id"), "vec").limit(SAMPLE).collect()
    x = np.frombuffer(b"".join(r["vec"] for r in few), np.float64).reshape(-1, width)
    wished = max(2, min(MOST_CENTROIDS, round((total / ENTRIES_PER_LIST) ** 0.5)))
    centres = kmeans(x[:, : width // 2], wished), kmeans(x[:, width // 2 :], wished)

    index = _tables.written(packed.mapInArrow(_assign(centres, width), "vec_id long, vec binary, cell int"), "index")
    lists = len(centres[0]) * len(centres[1])
    sizes = np.zeros(lists, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MOST_CENTROIDS**2 rows
        sizes[r["cell"]] = r["count"]
    blocks = -(-total // BLOCK)
    queries = index.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    wanted = total if share >= 1 else max(20 * k, int(np.ceil(share * total)))

    probes = queries.mapInArrow(_probes(centres, sizes, blocks, wanted, width), "block int, query_id long, query binary, cells binary")
    probes = _tables.written(probes, "probes")
    copies = probes.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("copies"))  # one row a block
    entries = index.mapInArrow(_entries(sizes, blocks), "block int, vec_id long, vec binary, cell int").join(copies, "block")
    entries = entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    probes = probes.join(copies, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int")).drop("copies")
    found = entries.groupBy("block", "part").cogroup(probes.groupBy("block", "part")).applyInArrow(_rerank(k, width, lists), "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
