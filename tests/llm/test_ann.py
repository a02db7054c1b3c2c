import numpy as np
import pytest

from tessera.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


def brute(rows, k):
    """Rows (query, rank, id, distance) by plain comparison in double precision."""
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(np.array(v, np.float32) != 0)]
    out = []
    for q in sorted({i for i, _ in sound if i % 100 == 0}):
        mine = min((v.tolist() for i, v in sound if i == q), key=lambda v: np.array(v).tobytes())
        near = sorted((float(np.sqrt(((v - np.array(mine)) ** 2).sum())), i) for i, v in sound if i != q)[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return out


def vectors(n, seed=3, width=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    return [(i, (centres[i % 6] + 0.3 * r.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def test_exact_with_everything_visited(spark):
    rows = vectors(700) + [(10_000 + i, vectors(1)[0][1]) for i in range(30)]  # ties
    rows += [(5, vectors(6)[5][1]), (2000, None), (2100, [0.0] * 8), (2200, [1.0] * 7 + [None]), (2300, [1.0] * 7 + [float("nan")]), (2400, [1.0] * 7 + [float("inf")]), (2500, [1.0]), (None, [1.0] * 8)]
    got = sorted(map(tuple, ann.nearest(table(spark, rows), k=10, share=1.0).collect()))
    want = brute(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_recall(spark):
    rows = vectors(4000)
    got = ann.nearest(table(spark, rows)).collect()
    want = {(q, i) for q, _, i, _ in brute(rows, 10)}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


def test_few_and_none(spark):
    rows = vectors(4)
    assert [tuple(r)[:3] for r in ann.nearest(table(spark, rows)).orderBy("rank").collect()] == [w[:3] for w in brute(rows, 10)]
    assert ann.nearest(table(spark, rows[:1])).count() == 0
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(0, None), (100, [])])).count() == 0


def test_multi_sequence_order():
    r = np.random.default_rng(2)
    a, b, sizes = r.random(7), r.random(5), r.integers(0, 3, 35)
    got = ann.multi_sequence(a, b, sizes, 10**6)
    total = [a[c // 5] + b[c % 5] for c in got]
    assert total == sorted(total) and sorted(got) == np.flatnonzero(sizes).tolist()
