import datetime
import json
import math
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera.functions import genres
from tessera.operators import coldstart, diversity, encode, factor, graph, lsh, popularity, ranking, recommend, similarity, split
from tessera.plans import http, runner, serve
from tessera.sources import download, sinks, tables
from tessera.sources.registry import ModelRegistry
from tessera.streaming import popular as streaming

DAY = datetime.datetime(2024, 1, 1)


def inter(spark, rows):
    """(user, item, r2, time) rows as interactions."""
    rows = [(u, i, r2, r2 / 2.0, DAY + datetime.timedelta(seconds=t)) for u, i, r2, t in rows]
    return spark.createDataFrame(rows, "user_id long, item_id long, r2 long, rating double, ts timestamp_ntz")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, title string, genres string")


def sizes(df, column="split"):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


FILMS = [(1, "Toy Story (1995)", "Animation|Children|Comedy"), (2, "Space Comedy", "Animation|Comedy"), (3, "Legal Drama", "Drama")]


def test_split_has_no_leak(spark):
    rows = split.three_way(inter(spark, [(u, 100 + i, 8, i) for u in (1, 2) for i in range(10)]))
    assert sizes(rows) == {"train": 12, "val": 4, "test": 4}
    part = {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}
    split.verify(part["train"], part["val"])
    with pytest.raises(ValueError):
        split.verify(part["test"], part["train"])


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (4, (2, 1, 1)), (10, (6, 2, 2))])
def test_split_sizes(spark, n, want):
    rows = inter(spark, [(1, i, 8, 0) for i in range(n)])
    got = sizes(split.three_way(rows))
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want
    two = sizes(split.two_way(rows))
    assert two.get("test", 0) == (max(1, n // 5) if n > 1 else 0)


def test_split_ratios_leave_a_training_row(spark):
    got = sizes(split.three_way(inter(spark, [(1, i, 8, i) for i in range(5)]), 0.6, 0.6))
    assert got == {"train": 1, "val": 1, "test": 3}


def test_stored_split(spark, tmp_path):
    rows = inter(spark, [(1, i, 8, i) for i in range(10)])
    path = str(tmp_path / "s")
    assert sizes(tables.stored_split(rows, path)) == sizes(tables.stored_split(rows, path)) == {"train": 6, "val": 2, "test": 2}
    assert len(list((tmp_path / "s").iterdir())) == 1
    tables.stored_split(rows.where("item_id > 2"), path)
    assert len(list((tmp_path / "s").iterdir())) == 2


def test_ranking_metrics(spark):
    recs = spark.createDataFrame([(1, i, 1.0, r) for r, i in enumerate((10, 20, 30, 40), 1)], "user_id long, item_id long, score double, rank long")
    truth = spark.createDataFrame([(1, 20), (1, 40), (1, 99), (2, 5)], "user_id long, item_id long")
    got = {r.user_id: r for r in ranking.per_user(recs, truth, 4).collect()}
    assert got[1].precision == 0.5 and got[1].recall == pytest.approx(2 / 3) and got[1].ndcg == pytest.approx(0.498189, abs=1e-6)
    assert (got[2].precision, got[2].recall, got[2].ndcg) == (0, 0, 0)
    row = ranking.evaluate(recs, truth, 8, 4).first()
    assert (row.users, row.precision, row.coverage) == (2, 0.25, 0.5)
    assert ranking.evaluate(recs, truth, 8, 0).first().precision == 0
    sweep = {r.k: r for r in ranking.sweep_ks(recs, truth, [1, 4]).collect()}
    assert sweep[4].ndcg == row.ndcg and sweep[1].precision == 0


def test_cosine_and_jaccard(spark):
    rows = inter(spark, [(1, 1, 3, 0), (1, 2, 4, 0), (2, 1, 4, 0)])
    pair = similarity.cosine_pairs(rows).first()
    assert (pair.a, pair.b, pair.dot, pair.sim) == (1, 2, 12, 0.6)
    sets = spark.createDataFrame([(1, t) for t in (1, 2, 3)] + [(2, t) for t in (2, 3, 4)] + [(3, 9)], "item_id long, token long")
    got = similarity.jaccard_pairs(sets).collect()
    assert [(r.a, r.b, r.shared, r.sim) for r in got] == [(1, 2, 2, 0.5)]
    assert [(r.a, r.b) for r in similarity.nearest(similarity.jaccard_pairs(sets), 1).orderBy("a").collect()] == [(1, 2), (2, 1)]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_prefix_filtered_jaccard_loses_nothing(spark, threshold):
    import random

    rng = random.Random(threshold)
    base = [rng.sample(range(40), 12) for _ in range(6)]
    rows = [(i, t) for i in range(60) for t in set(rng.choice(base)) ^ set(rng.sample(range(60), rng.randint(0, 3)))]
    sets = spark.createDataFrame(rows, "item_id long, token long")
    want = {(r.a, r.b) for r in similarity.jaccard_nested(sets).where(F.col("sim") >= threshold).collect()}
    assert {(r.a, r.b) for r in similarity.jaccard_at_least(sets, threshold).collect()} == want


def test_lsh(spark):
    assert lsh.band_shape(0.5) == (25, 5) and lsh.band_shape(0.3) == (37, 3) and lsh.band_shape(0.2) == (28, 2)
    sets = spark.createDataFrame([(1, t) for t in range(50)] + [(2, t) for t in range(2, 50)] + [(3, t) for t in range(900, 950)], "item_id long, token long")
    sigs = lsh.signatures(sets, 128)
    pairs = lsh.candidate_pairs(lsh.buckets(sigs, 25, 5))
    assert [(r.a, r.b, r.sim) for r in lsh.verified(pairs, sets).collect()] == [(1, 2, 0.96)]
    row = lsh.recall(pairs, similarity.jaccard_pairs(sets), 3, 0.5).first()
    assert (row.candidate_pairs, row.all_pairs, row.true_pairs, row.recall, row.pair_reduction_x) == (1, 3, 1, 1.0, 3.0)


def test_encoders(spark):
    rows = inter(spark, [(7, 1, 6, 0), (7, 5, 8, 1), (3, 1, 2, 0)])
    assert {r.id: r.idx for r in encode.id_map(rows.select("user_id")).collect()} == {3: 0, 7: 1}
    assert encode.adjacency_differs(rows).count() == 0
    assert [tuple(x) for x in encode.rating_lists(rows).where("user_id = 7").first().ratings] == [(1, 3.0), (5, 4.0)]
    s = encode.statistics(rows).first()
    assert (s.users, s.items, s.interactions, s.busiest_user, s.top_item) == (2, 2, 3, 7, 1)
    assert encode.csr_memory_mb(10, 100) == pytest.approx((1200 + 44) / 2**20)


def test_popularity_and_fallback(spark):
    rows = inter(spark, [(1, 1, 8, 0), (2, 1, 8, 0), (2, 2, 8, 0), (3, 1, 8, 0), (3, 2, 8, 0), (3, 3, 8, 0), (4, 4, 8, 0)])
    popular, users = popularity.counts(rows), rows.select("user_id").distinct()
    assert [(r.item_id, r.pop_rank) for r in popularity.ranks(popular).orderBy("pop_rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    recs = popularity.recommend(users, rows, popular, 2)
    got = {u: [(r.item_id, r.rank) for r in sorted(recs.where(F.col("user_id") == u).collect(), key=lambda r: r.rank)] for u in (1, 2, 3, 4)}
    assert got == {1: [(2, 1), (3, 2)], 2: [(3, 1), (4, 2)], 3: [(4, 1)], 4: [(1, 1), (2, 2)]}
    near = similarity.nearest(similarity.cosine_pairs(rows), 20)
    filled = recommend.item_cf_filled(rows, near, users, popular, 4.0, 3)
    assert filled.join(rows, ["user_id", "item_id"], "left_semi").count() == 0
    assert filled.groupBy("user_id").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("item_id").alias("d")).where("n <> m or n <> d").count() == 0


GRAPH = [(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "b"), (3, "c"), (3, "d"), (4, "e")]


def test_three_hops_and_page_rank(spark):
    g = spark.createDataFrame([(u, ord(i) - 96) for u, i in GRAPH], "user_id long, item_id long")
    assert {(r.item_id, r.score) for r in graph.three_hop(g).where("user_id = 1").collect()} == {(3, 2), (4, 1)}
    one = graph.page_rank(spark.createDataFrame([(1, 1), (1, 2)], "user_id long, item_id long"), odd_steps=1).collect()
    assert sorted((r.item_id, round(r.score, 9)) for r in one) == [(1, 0.06375), (2, 0.06375)]
    users = g.select("user_id").distinct()
    recs = graph.bfs_recommend(g, users, popularity.counts(g), 3)
    assert [r.item_id for r in recs.where("user_id = 1").orderBy("rank").collect()] == [3, 4, 5]
    assert graph.ppr_recommend(graph.page_rank(g), g, users, popularity.counts(g), 3).where("user_id = 4").count() == 3


def test_components_and_quality(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (5, 6, 0.9), (6, 7, 0.1)], "a long, b long, sim double")
    got = graph.clusters(pairs, spark.range(1, 8).withColumnRenamed("id", "item_id"), 0.5)
    assert {r.item_id: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert graph.components(chain).select("component").distinct().collect()[0][0] == 0
    labels = spark.createDataFrame([(0, "Action"), (1, "Action"), (2, "Drama"), (3, "Comedy")], "item_id long, label string")
    made = lambda rows: graph.cluster_quality(spark.createDataFrame(rows, "item_id long, component long"), labels).first()
    giant, apart = made([(0, 0), (1, 0), (2, 0), (3, 0)]), made([(0, 0), (1, 0), (2, 2), (3, 3)])
    assert giant.largest_component_ratio == 1.0 and giant.selection_score == 0.0
    assert apart.purity == 1.0 and apart.selection_score == 0.25
    assert made([(0, 0), (1, 0)]).entropy == 0.0 and made([(0, 0), (2, 0)]).entropy == 1.0
    best = graph.cluster_examples(spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "item_id long, component long"), labels).first()
    assert (best.component, best.size, best.members, best.label) == (0, 2, "0,1", "Action")


def test_genres(spark):
    df = items(spark, [(1, "x", None), (2, "x", ""), (3, "x", "(no genres listed)"), (4, "x", "A||B"), (5, "x", "Drama|War")])
    got = {r.item_id: (r.g, r.p) for r in df.select("item_id", genres.parse(F.col("genres")).alias("g"), genres.primary(F.col("genres")).alias("p")).collect()}
    assert got == {1: ([], "unknown"), 2: ([], "unknown"), 3: ([], "unknown"), 4: (["A", "B"], "A"), 5: (["Drama", "War"], "Drama")}
    assert {r.genre: r.weight for r in genres.vectors(df).where("item_id = 4").collect()} == pytest.approx({"A": 2**-0.5, "B": 2**-0.5})
    assert {r.genre: r.value for r in genres.encode(["A", "?"], genres.vocabulary(df)).collect()} == {"A": 1, "B": 0, "Drama": 0, "War": 0}


def test_cold_start(spark):
    df = items(spark, FILMS)
    got = coldstart.for_new_user(df, ["Toy Story (1995)"]).collect()
    assert [(r.title, r.jaccard) for r in got] == [("Space Comedy", 0.666667)]
    got = coldstart.for_new_item(df, ["Animation", "Comedy"]).collect()
    assert [(r.title, r.jaccard) for r in got] == [("Space Comedy", 1.0), ("Toy Story (1995)", 0.666667)]
    assert coldstart.for_new_user(df, ["nothing"]).count() == 0 and coldstart.for_new_user(df, []).count() == 0
    assert all(coldstart.validation(df, ["Toy Story (1995)"], ["Comedy"]).first())


def test_normalised(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 3.0), (2, 1, 7.0), (2, 2, 7.0)], "user_id long, item_id long, score double")
    assert sorted((r.user_id, r.item_id, r.score) for r in ranking.normalised(rows).collect()) == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.5), (2, 1, 1.0), (2, 2, 1.0)]


def test_mmr_diversity_novelty(spark):
    films = items(spark, [(1, "a", "X"), (2, "b", "X"), (3, "c", "Z")])
    pool = spark.createDataFrame([(9, 1, 1.0, 1), (9, 2, 0.9, 2), (9, 3, 0.0, 3)], "user_id long, item_id long, score double, rank long")
    for f in (diversity.mmr, diversity.mmr_native):
        got = f(pool, films, 0.5, 3).orderBy("rank").collect()
        assert [r.item_id for r in got] == [1, 3, 2] and [r.score for r in got] == pytest.approx([1.0, 0.0, -0.05])
    assert diversity.intra_list(pool, films).first().diversity == pytest.approx(2 / 3)
    assert diversity.intra_list(pool.where("rank = 1"), films).first().diversity == 0
    popular = spark.createDataFrame([(1, 5)], "item_id long, cnt long")
    got = diversity.novelty(pool.where("item_id < 3"), popular, 10).first().novelty
    assert got == pytest.approx((1 - math.log2(1e-10)) / 2)


def test_svd(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for users, things in ((12, 7), (6, 15)):
        m = rng.integers(0, 2, (users, things)) * rng.integers(1, 11, (users, things))
        rows = inter(spark, [(u, i, int(m[u, i]), 0) for u in range(users) for i in range(things) if m[u, i]])
        full = np.linalg.svd(m / 2.0)
        for fit in (lambda: factor.svd(rows, 3), lambda: factor._subspace(rows.select("user_id", "item_id", F.col("rating").alias("v")), 3)):
            left, right, s = fit()
            assert s == pytest.approx(full[1][:3], rel=1e-3)
            u = {r.user_id: np.array(r.vector) for r in left.collect()}
            v = {r.item_id: np.array(r.vector) for r in right.collect()}
            want = (full[0][:, :3] * full[1][:3]) @ full[2][:3]
            assert all(abs(u[a] @ v[b] - want[a, b]) < 2e-2 for a in u for b in v)
            if fit.__code__.co_names[1] == "_subspace" or users * things > 200:
                continue
            recs = factor.recommend(left, right, rows, 2).collect()
            for r in recs:
                open_ = [(-round(float(u[r.user_id] @ v[i]), 9), i) for i in v if not m[r.user_id, i]]
                assert sorted(open_)[r.rank - 1][1] == r.item_id


def test_svd_of_a_flat_spectrum(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    m = np.zeros((240, 300))
    for row in m:
        row[rng.choice(300, 12, replace=False)] = rng.integers(1, 11, 12) / 2
    cells = spark.createDataFrame([(int(u), int(i), float(m[u, i])) for u, i in zip(*m.nonzero(), strict=True)], "user_id long, item_id long, v double")
    full = np.linalg.svd(m)
    left, right, s = factor._subspace(cells, 12)
    assert s == pytest.approx(full[1][:12], rel=1e-9)
    got = np.zeros_like(m)
    u, v = {r.user_id: r.vector for r in left.collect()}, {r.item_id: r.vector for r in right.collect()}
    for a in u:
        for b in v:
            got[a, b] = np.dot(u[a], v[b])
    assert np.abs(got - (full[0][:, :12] * full[1][:12]) @ full[2][:12]).max() < 1e-4
    with pytest.raises(ArithmeticError):
        factor._subspace(cells, 12, rounds=1)


def test_factor_neighbours_and_titles(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "item_id long, vector array<double>")
    support = spark.createDataFrame([(2, 15), (3, 20), (4, 99), (1, 99)], "item_id long, cnt long")
    assert [(r.item_id, r.rank) for r in factor.nearest_items(vectors, 1, support).orderBy("rank").collect()] == [(2, 1), (3, 2), (4, 3)]
    films = items(spark, FILMS)
    assert factor.find_title(films, "toy story (1995)").first().item_id == 1
    assert {r.title for r in factor.with_titles(spark.createDataFrame([(3,), (8,)], "item_id long"), films).collect()} == {"Legal Drama", "Unknown Movie"}


def test_winner(spark):
    rows = spark.createDataFrame([("mf", 1.2, 0.08), ("graph", 38.0, 0.09)], "method string, ms_per_req double, ndcg double")
    assert tuple(recommend.pick_winner(rows).first()) == ("mf", "best ndcg@10 under 10ms")
    assert tuple(recommend.pick_winner(rows, 1.0).first()) == ("graph", "best ndcg@10 overall")


def test_registry(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "r"))
    assert registry.registered().count() == 0
    with pytest.raises(ValueError):
        registry.load("x")
    assert [registry.register("x", {"t": spark.range(n)}, {"n": n}) for n in (1, 2)] == [1, 2]
    assert registry.load("x")["t"].count() == 2 and registry.load("x", 1)["t"].count() == 1
    assert registry.latest("x")["metrics"] == {"n": 2.0}


def test_service(spark, tmp_path):
    rows = inter(spark, [(u, i, 1 + (u * i) % 10, i) for u in range(1, 7) for i in range(1, 13) if (u + i) % 3])
    films = items(spark, [(i, f"film {i}", "A") for i in range(1, 12)])
    train = split.three_way(rows).where("split = 'train'").drop("split")
    state = serve.ModelState(train, rows, films, rows.select("user_id").distinct(), factors=2)
    service = serve.Service(spark, str(tmp_path / "m"))
    with pytest.raises(RuntimeError):
        service.recommend(1)
    service.publish(state)
    service.load()
    assert service.methods() == ["graph", "item_cf", "mf", "popularity"]
    health = service.health()
    assert health["status"] == "ok" and health["loaded"] and health["users"] == 6 and health["items"] == 11
    known = {r.item_id for r in rows.where("user_id = 1").collect()}
    for method in service.methods():
        got = service.recommend(1, 3, method)
        assert got["method"] == method and len(got["items"]) == 3 and set(got["items"][0]) == {"item_id", "title", "score"}
        assert not known & {x["item_id"] for x in got["items"]}
    with pytest.raises(ValueError):
        service.recommend(1, 3, "other")
    with pytest.raises(ValueError):
        service.recommend(1, 51, "mf")
    with pytest.raises(KeyError):
        service.recommend(999999)
    with pytest.raises(RuntimeError):
        service.load(rebuild=True)
    assert serve.cache_benchmark(service, 1)["warm_ms"] < serve.cache_benchmark(service, 1)["cold_ms"]
    status = lambda path, **q: service.handle(path, q)[0]
    assert [status("/health"), status("/methods"), status("/compare"), status("/x")] == [200, 200, 503, 404]
    assert [status("/recommend/1", n="3", method="mf"), status("/recommend/1", method="other"), status("/recommend/a"), status("/recommend/999999")] == [200, 400, 400, 404]
    rows = spark.createDataFrame([("mf", 0.1, 0.1, 0.08, 0.5, 1.2), ("graph", 0.1, 0.1, 0.09, 0.5, 38.0)], "method string, precision_at_10 double, recall_at_10 double, ndcg_at_10 double, coverage double, ms_per_req double")
    service.publish_comparison(rows)
    report = serve.validation_report(service.load(), str(tmp_path / "report.json"), 1)
    assert report["winner"] == {"method": "mf", "rule": "best ndcg@10 under 10ms"} and report["comparison"]["graph"]["ndcg_at_10"] == 0.09
    assert json.loads((tmp_path / "report.json").read_text())["winner"] == report["winner"] and status("/compare") == 200
    before = service.recommend(1, 3, "popularity")["items"]
    service.registry.register("popularity", {"recs": service.tables["popularity"].where("rank > 1").withColumn("rank", F.col("rank") - 1)})
    assert service.recommend(1, 3, "popularity")["items"] == before and service.load().recommend(1, 3, "popularity")["items"] != before
    web = http.server(service, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/recommend/1?n=2&method=mf") as answer:
        assert len(json.load(answer)["items"]) == 2
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/recommend/999999")
    web.shutdown()
    web.server_close()


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,964982703\n")
    (tmp_path / "m.csv").write_text('movieId,title,genres\n2,"American President, The (1995)",Comedy|Drama\n')
    assert tuple(tables.read_ratings(spark, str(tmp_path / "r.csv")).first())[:4] == (1, 2, 7, 3.5)
    assert tables.read_items(spark, str(tmp_path / "m.csv")).first().title == "American President, The (1995)"
    sinks.write_json(str(tmp_path / "o" / "x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "o" / "x.json").read_text().startswith('{\n  "a"')
    sinks.write_csv(spark.range(2), str(tmp_path / "c"))
    sinks.write_csv(spark.range(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2 and not (tmp_path / "none").exists()
    assert "| 1 |" in sinks.report("t", spark.range(2))


def test_stream(spark, tmp_path):
    rows = [(i, DAY + datetime.timedelta(minutes=7 * i), 1, "v", 1.0, f'{{"k": {i % 3}}}') for i in range(40)]
    events = spark.createDataFrame(rows, streaming.EVENTS)
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "e"))
    query = streaming.windowed(streaming.stream(spark, str(tmp_path / "e"), 10)).writeStream.outputMode("complete").format("memory").queryName("popular").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("popular").collect()))
    assert got == sorted(map(tuple, streaming.windowed(events).collect())) and sum(r[2] for r in got) == 40


def test_results_do_not_depend_on_partitions(spark):
    rows = inter(spark, [(u, (u * 7 + i * i) % 23, 1 + (u + i) % 10, 0) for u in range(40) for i in range(9)])
    rows = rows.dropDuplicates(["user_id", "item_id"])
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    seen = []
    for n in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        train = split.three_way(rows.repartition(n)).where("split = 'train'").drop("split")
        near = similarity.nearest(similarity.cosine_pairs(train), 5)
        seen.append(sorted(map(tuple, recommend.item_cf(train, near, train, 5).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60


def test_blocked_three_hops_and_item_polynomial(spark, monkeypatch):
    """Small blocks, and whole users or single seeds, give what plain walks give."""
    import numpy as np

    rng = np.random.default_rng(4)
    b = (rng.random((23, 17)) < 0.15).astype(float)
    g = spark.createDataFrame([(int(u), int(i)) for u, i in zip(*b.nonzero(), strict=True)], "user_id long, item_id long")
    monkeypatch.setattr(graph, "USER_BLOCK", 5)
    monkeypatch.setattr(graph, "ITEM_BLOCK", 4)
    want = ((b @ b.T > 0) @ b) * (b == 0)
    assert {(r.user_id, r.item_id): r.score for r in graph.three_hop(g).collect()} == {(int(u), int(i)): want[u, i] for u, i in zip(*want.nonzero(), strict=True)}
    du, di = np.maximum(b.sum(1), 1), np.maximum(b.sum(0), 1)
    walk, total = b / du[:, None], 0
    for t in range(5):
        total = total + 0.15 * 0.85 ** (2 * t + 1) * walk
        walk = (walk / di) @ b.T @ (b / du[:, None])
    got = {(r.seed, r.item_id): r.score for r in graph.page_rank(g).collect()}
    assert got == pytest.approx({(int(u), int(i)): total[u, i] for u, i in zip(*total.nonzero(), strict=True)})
    some = {(r.seed, r.item_id): r.score for r in graph.page_rank(g, seeds=g.select("user_id").where("user_id < 3")).collect()}
    assert some == pytest.approx({k: v for k, v in got.items() if k[0] < 3})


def test_equal_sets_link_without_all_their_pairs(spark):
    rows = [(i, t) for i in range(12) for t in ("a", "b", "c")] + [(20, t) for t in "abcd"] + [(30, "z")]
    sets = spark.createDataFrame(rows, "item_id long, token string")
    assert similarity.jaccard_at_least(sets, 0.7).count() == 12 * 11 // 2 + 12
    few = similarity.jaccard_at_least(sets, 0.7, expand=False)
    assert few.count() == 12
    found = {r.item_id: r.component for r in graph.clusters(few, sets.select("item_id").distinct(), 0.7).collect()}
    assert found == {**{i: 0 for i in (*range(12), 20)}, 30: 30}


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "a long, b long").repartition(7)
    got = {r.a: (r.b, r.idx) for r in ranking.numbered(rows, F.desc("a")).collect()}
    assert got == {i * 7 % 50: (i, 49 - i * 7 % 50) for i in range(50)}
    assert ranking.numbered(rows.limit(0), "a").count() == 0


def test_svd_with_and_without_room(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    m = np.zeros((60, 90))
    for row in m:
        row[rng.choice(90, 7, replace=False)] = rng.integers(1, 11, 7) / 2
    cells = spark.createDataFrame([(int(u), int(i), float(m[u, i])) for u, i in zip(*m.nonzero(), strict=True)], "user_id long, item_id long, rating double")
    full = np.linalg.svd(m)
    for room in (4 << 20, 10):
        monkeypatch.setattr(factor, "CELLS_IN_A_TASK", room)
        left, right, s = factor.svd(cells, 5)
        assert s == pytest.approx(full[1][:5], rel=1e-9)
        u, v = {r.user_id: np.array(r.vector) for r in left.collect()}, {r.item_id: np.array(r.vector) for r in right.collect()}
        want = (full[0][:, :5] * full[1][:5]) @ full[2][:5]
        assert max(abs(u[a] @ v[b] - want[a, b]) for a in u for b in v) < 1e-4
    assert [x.count() for x in factor.svd(cells.limit(0), 3)[:2]] == [0, 0]
    a = m @ m.T
    with pytest.raises(ArithmeticError):
        factor.leading(lambda x: a @ x, rng.normal(size=(60, 4)), 5, rounds=2)


def test_runner(spark, tmp_path):
    films = items(spark, FILMS)
    table = {"films": lambda s, d: films, "none": lambda s, d: films.limit(0)}
    got = runner.run(spark, "", ("films", "none"), table, str(tmp_path / "a")).collect()
    assert [(r.step, r.rows) for r in got] == [("films", films.count()), ("none", 0)]
    assert spark.read.option("header", True).csv(str(tmp_path / "a" / "films")).count() == films.count()
    spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 4, i % 4 + 9))) for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = runner.lsh_table(spark, str(tmp_path), 16, [0.5], 3, brute_force=True).first()
    assert row.brute_force_seconds > 0 and row.exact_seconds > 0
    assert row.true_pairs == 66 and 0 < row.recall <= 1


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from tessera.sources import shared

    held = {"spark.checkpoint.dir": None, "tessera.shared.dir": None}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: held.get(k, d)), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError):
        shared.folder(cluster)
    held["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared.folder(cluster) == "hdfs://x/y"


def test_hot_keys_are_dealt(spark, monkeypatch):
    rows = inter(spark, [(u, i, 1 + (u * i) % 10, 0) for u in range(4) for i in range(12) if (u + i) % 3 or not u])
    sets = rows.select("item_id", F.col("user_id").alias("token"))
    want = [sorted(map(tuple, f.collect())) for f in (similarity.cosine_pairs(rows), similarity.jaccard_pairs(sets))]
    monkeypatch.setattr(similarity, "ROWS_OF_A_KEY", 3)
    assert [sorted(map(tuple, f.collect())) for f in (similarity.cosine_pairs(rows), similarity.jaccard_pairs(sets))] == want
    one = spark.createDataFrame([(i, 0, "k") for i in range(9)], "item_id long, band int, key string")
    assert lsh.candidate_pairs(one).count() == 36


def test_fetch(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ml/ratings.csv", "userId")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.csv", "x")
    url = (tmp_path / "a.zip").as_uri()
    got = download.fetch(url, str(tmp_path / "data"))
    assert got == [str(tmp_path / "data" / "ml" / "ratings.csv")]
    (tmp_path / "a.zip").unlink()
    assert download.fetch(url, str(tmp_path / "data")) == got
    with pytest.raises(ValueError):
        download.fetch((tmp_path / "bad.zip").as_uri(), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists() and not (tmp_path / "out.csv").exists()


def test_plot(spark, tmp_path):
    rows = spark.createDataFrame([(10, 0.1, 0.3), (50, 0.2, 0.25), (20, None, 1.0)], "k long, a double, b double")
    sinks.write_plot(str(tmp_path / "p.svg"), rows, "k", "a", "b")
    drawn = (tmp_path / "p.svg").read_text()
    assert drawn.count("<polyline") == 2 and ">50<" in drawn and ">20<" not in drawn
    assert sinks.plot(rows.limit(0), "k", "a").startswith("<svg")


def test_tiles_of_any_size_give_the_same_pairs(spark, monkeypatch):
    """Pairs and nearest lists, over tiles and runs much smaller than the input, against plain loops."""
    from tessera.operators import tiles

    monkeypatch.setattr(tiles, "CELLS", 40)
    monkeypatch.setattr(tiles, "DEALT", 25)
    monkeypatch.setattr(tiles, "PRODUCTS", 60)
    rng = random.Random(5)
    rated = {(u, rng.choice([rng.randrange(40), 10**12 + rng.randrange(9)])): rng.randint(1, 10) for u in range(30) for _ in range(12)}
    rows = spark.createDataFrame([(u, i, r) for (u, i), r in rated.items()], "user_id long, item_id long, r2 long").repartition(3)
    by_user, norm = {}, {}
    for (u, i), r in rated.items():
        by_user.setdefault(u, []).append((i, r))
        norm[i] = norm.get(i, 0) + r * r
    dots = {}
    for mine in by_user.values():
        for i, r in mine:
            for j, s in mine:
                if i < j:
                    dots[i, j] = dots.get((i, j), 0) + r * s
    pairs = similarity.cosine_pairs(rows)
    assert {(p.a, p.b): (p.dot, p.sim) for p in pairs.collect()} == {k: (d, d / (norm[k[0]] * norm[k[1]]) ** 0.5) for k, d in dots.items()}
    near = lambda f: sorted(map(tuple, f.select("a", "b", "sim", "simq", "rank").collect()))
    assert near(similarity.nearest_cosine(rows, 4)) == near(similarity.nearest(pairs, 4))
    sets = rows.select("item_id", F.col("user_id").alias("token"))
    assert near(similarity.nearest_jaccard(sets, 3)) == near(similarity.nearest(similarity.jaccard_pairs(sets), 3))
    some = similarity.jaccard_pairs(sets).select("a", "b", F.col("sim").alias("s")).join(similarity.jaccard_nested(sets), ["a", "b"])
    assert some.where("s <> sim").count() == 0 and some.count() == len(dots)
    with pytest.raises(TypeError):
        similarity.jaccard_pairs(spark.createDataFrame([("x", 1)], "item_id string, token long"))


def test_best_sums_in_small_blocks(spark, monkeypatch):
    """The best of each user by blocks of users, against all candidates joined and ranked."""
    from tessera.operators import tiles

    monkeypatch.setattr(tiles, "CELLS", 50)
    monkeypatch.setattr(tiles, "PRODUCTS", 40)
    rng = random.Random(6)
    rated = {(u, rng.randrange(60)): rng.randint(1, 10) for u in range(40) for _ in range(14)}
    rows = spark.createDataFrame([(u, i, r) for (u, i), r in rated.items()], "user_id long, item_id long, r2 long")
    near, likes = similarity.nearest_cosine(rows, 6), recommend.liked(rows, 3.0)
    got = tiles.best_sums(likes, near, rows, 5).select("user_id", "item_id", "scoreq", "rank")
    want = ranking.top_n(recommend.candidates(likes, near, rows), 5, score="scoreq").select("user_id", "item_id", "scoreq", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    assert tiles.best_sums(likes.limit(0), near, rows, 5).count() == 0


def test_first_tokens_in_small_tiles(spark, monkeypatch):
    """Pairs at a threshold over tiles of a few cells, against all pairs; far fewer than share a token leave the tiles."""
    from tessera.operators import tiles

    monkeypatch.setattr(tiles, "CELLS", 150)
    monkeypatch.setattr(tiles, "DEALT", 60)
    monkeypatch.setattr(tiles, "PRODUCTS", 90)
    made, prefix = [], tiles.prefix_pairs
    monkeypatch.setattr(tiles, "prefix_pairs", lambda *a: (made.append(prefix(*a)), made[-1])[1])
    rng = random.Random(9)
    texts = [set(rng.choices(range(120), k=rng.randint(3, 40))) for _ in range(60)]
    texts += [(x - set(rng.sample(sorted(x), 2))) | {500 + i} for i, x in enumerate(texts[:25])] + texts[30:36]
    rows = spark.createDataFrame([(i, t) for i, x in enumerate(texts) for t in x], "item_id long, token long")
    everything = {(r.a, r.b): r.sim for r in similarity.jaccard_nested(rows).collect()}
    for t in (0.3, 0.5, 0.8):
        got = {(r.a, r.b): r.sim for r in similarity.jaccard_at_least(rows, t).collect()}
        assert got == {k: s for k, s in everything.items() if s >= t}
        pairs = [tuple(p) for p in made[-1].collect()]
        assert len(pairs) == len(set(pairs)) < sum(s > 0 for s in everything.values())


def test_svd_of_parts_and_of_equal_values(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    m = rng.integers(1, 11, (30, 40)) * (rng.random((30, 40)) < 0.3) / 2
    whole = np.kron(np.eye(3), m)  # three parts, every singular value three times
    cells = [(int(u), int(i), float(whole[u, i])) for u, i in zip(*whole.nonzero(), strict=True)]
    left, right, s = factor.svd(spark.createDataFrame(cells, "user_id long, item_id long, rating double"), 6)
    full = np.linalg.svd(whole)
    assert s == pytest.approx(full[1][:6], rel=1e-9)
    u, v = {r.user_id: np.array(r.vector) for r in left.collect()}, {r.item_id: np.array(r.vector) for r in right.collect()}
    want = (full[0][:, :6] * full[1][:6]) @ full[2][:6]
    assert max(abs(u[a] @ v[b] - want[a, b]) for a in u for b in v) < 1e-4
    parts = factor._parts(pa_table(cells))
    assert len(set(parts.column("part").to_pylist())) == 3
    value, vector = factor.leading(lambda x: x * np.r_[np.full(40, 5.0), np.ones(300)][:, None], rng.normal(size=(340, 16)), 30)
    assert value == pytest.approx(np.full(30, 5.0)) and np.abs(vector[40:]).max() < 1e-6  # more equal values than columns of a block


def pa_table(cells):
    import pyarrow as pa

    return pa.table(dict(zip(("user_id", "item_id", "v"), zip(*cells, strict=True), strict=True)))


def test_svd_takes_few_products():
    """A flat spectrum: residuals of the first unconverged pairs took 40 products for this."""
    import numpy as np

    rng = np.random.default_rng(4)
    a = rng.normal(size=(600, 700)) * (rng.random((600, 700)) < 0.05)
    a, columns = a @ a.T, []
    value, _ = factor.leading(lambda x: (columns.append(x.shape[1]), a @ x)[1], rng.normal(size=(600, 16)), 20)
    assert value == pytest.approx(np.linalg.eigvalsh(a)[::-1][:20], rel=1e-9)
    assert len(columns) < 30


def test_lists_of_several_widths_are_those_of_each(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    left, right = rng.normal(size=(50, 6)), rng.normal(size=(70, 6))
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(left)], "user_id long, vector array<double>")
    items = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(right)], "item_id long, vector array<double>")
    seen = spark.createDataFrame([(u, 3 * ((u * 7 + j) % 80)) for u in range(50) for j in range(4)], "user_id long, item_id long")
    hidden = {(r.user_id, r.item_id) for r in seen.collect()}
    got = factor.recommend_widths(users, items, seen, [2, 5, 6], 4, user_rows=20, item_rows=30).collect()
    for width in (2, 5, 6):
        scores = left[:, :width] @ right[:, :width].T
        want = {u: [3 * int(i) for i in np.argsort(-scores[u]) if (u, 3 * int(i)) not in hidden][:4] for u in range(50)}
        own = sorted((r.user_id, r.rank, r.item_id) for r in got if r.factors == width)
        assert own == [(u, n + 1, i) for u in range(50) for n, i in enumerate(want[u])]


def test_signatures_of_runs_in_parts(spark, monkeypatch):
    """Minima of items whose rows are in several runs and partitions, null tokens too; and the plan has no hundred aggregates."""
    monkeypatch.setattr(lsh, "TOKENS_AT_ONCE", 7)
    rng = random.Random(3)
    data = [(rng.randint(1, 9), f"w{rng.randint(1, 60)}") for _ in range(300)] + [(50, None), (3, None)]
    sets = spark.createDataFrame(data, "item_id long, token string").repartition(3)
    hashes = {r.token: r.h for r in sets.select("token", lsh.token_hash(F.col("token")).alias("h")).collect()}
    want = {i: [min(((hashes[t] * a + b) % lsh.PRIME for j, t in data if j == i and t), default=None) for a, b in lsh.permutations(16)] for i in {x for x, _ in data}}
    made = lsh.signatures(sets, 16)
    assert {r.item_id: r.sig for r in made.collect()} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("min(") == 0


def test_blocks_of_unlike_sizes_never_meet(spark, monkeypatch):
    """Large and small sets share their rarest token: no tile of theirs is dealt, and nothing is lost."""
    from tessera.operators import tiles

    monkeypatch.setattr(tiles, "CELLS", 40)
    sizes, deal = [], tiles._deal
    monkeypatch.setattr(tiles, "_deal", lambda bounds, fits=None: (sizes.append(fits), deal(bounds, fits))[1])
    rng = random.Random(5)
    data = [(i, t) for i in range(40) for t in {0, *rng.choices(range(1, 30), k=4 if i % 2 else 25)}]
    rows = spark.createDataFrame(data, "item_id long, token long")
    got = {(r.a, r.b): r.sim for r in similarity.jaccard_at_least(rows, 0.6).collect()}
    assert got == {(r.a, r.b): r.sim for r in similarity.jaccard_nested(rows).collect() if r.sim >= 0.6} and got
    assert sizes[-1].diagonal().all() and not sizes[-1].all()


def test_lists_are_computed_once_when_filled(spark):
    """fill and compare read a method's lists several times; they are computed once."""
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    recs = spark.createDataFrame([(1, 7, 0.5, 1), (2, 8, 0.5, 1)], "user_id long, item_id long, score double, rank long")
    users, seen = spark.range(1, 4).withColumnRenamed("id", "user_id"), spark.createDataFrame([(1, 8)], "user_id long, item_id long")
    popular = spark.createDataFrame([(7, 3), (8, 2), (9, 1)], "item_id long, cnt long")
    got = popularity.fill(recs.mapInArrow(counted, recs.schema), users, seen, popular, 2)
    assert sorted((r.user_id, r.item_id, r.rank) for r in got.collect()) == [(1, 7, 1), (1, 9, 2), (2, 7, 2), (2, 8, 1), (3, 7, 1), (3, 8, 2)]
    assert ran.value == 2


def test_sets_as_arrays_are_verified_in_blocks(spark, monkeypatch):
    """Arrays of tokens, in parts, with nulls and repeats, give what rows of tokens give; a set is verified once a tile."""
    from tessera.operators import tiles

    monkeypatch.setattr(tiles, "CELLS", 60)
    monkeypatch.setattr(tiles, "COUNTS", 100)
    monkeypatch.setattr(tiles, "SUB", 7)
    monkeypatch.setattr(tiles, "VERIFIED", 200)
    rng = random.Random(11)
    texts = [[f"w{x}" for x in rng.choices(range(70), k=rng.randint(1, 30))] for _ in range(50)]
    texts += [x[1:] + ["new"] for x in texts[:20]] + texts[:5]
    parts = [(i, x) for i, x in enumerate(texts)] + [(3, ["more", None]), (None, ["w1"]), (900, []), (901, None)]
    arrays = spark.createDataFrame(parts, "item_id long, token array<string>")
    rows = arrays.select("item_id", F.explode("token").alias("token")).where("item_id is not null and token is not null").distinct()
    for t in (0.25, 0.6):
        want = {(r.a, r.b): r.sim for r in similarity.jaccard_nested(rows).collect() if r.sim >= t}
        got = similarity.jaccard_at_least(arrays, t).collect()
        assert {(r.a, r.b): r.sim for r in got} == want and len(got) == len(want) > 20
    named = tiles.hashed_sets(arrays, "item_id", "token")
    assert named.count() == len(texts) and named.where("item = 3 and n = %d" % (len(set(texts[3])) + 1)).count() == 1


def test_candidates_are_counted_without_their_list(spark, monkeypatch):
    """Recall by marks in tiles of a few signatures, against the list of candidates; the plan has no join by band."""
    rng = random.Random(4)
    texts = [rng.sample(range(40), rng.randint(2, 20)) for _ in range(40)]
    texts += [x[1:] for x in texts[:15]] + texts[:4]
    sets = spark.createDataFrame([(i, t) for i, x in enumerate(texts) for t in x], "item_id long, token long")
    sigs = lsh.signatures(sets, 32).cache()
    exact = similarity.jaccard_pairs(sets).cache()
    monkeypatch.setattr(lsh, "MARKED", 6)
    monkeypatch.setattr(lsh, "MARKS", 9)
    monkeypatch.setattr(lsh, "BLOCK", 25)
    for bands, rows, t in ((16, 2, 0.3), (8, 3, 0.6)):
        pairs = lsh.candidate_pairs(lsh.buckets(sigs, bands, rows)).cache()
        want = lsh.recall(pairs, exact, len(texts), t).first()
        assert lsh.counted_recall(sigs, exact, bands, rows, t).first() == want and 15 < want.candidate_pairs
    assert lsh.counted_recall(sigs.limit(0), exact.limit(0), 8, 3, 0.6).first().candidate_pairs == 0
