"""The registered queries (spark, sf_dir) -> DataFrame and, beside each, the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import genres
from tessera.operators import coldstart, diversity, encode, factor, graph, lsh, popularity, ranking, recommend, similarity, split
from tessera.plans import serve
from tessera.sources import tables
from tessera.sources.registry import ModelRegistry
from tessera.sources.shared import folder, written
from tessera.streaming import popular as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K, NEIGHBOURS = 10, 20
LIKED_TITLES, WANTED_GENRES = ["cold bolt", "red plate"], ["hot", "bolt"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Common table expressions of the SQL side.
RATINGS = "ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(max(ceil(l_quantity / 5)) AS BIGINT) AS r2, max(o_orderdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
EVENTS = "ev AS (SELECT user_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS item_id, max(value) AS value FROM events GROUP BY 1, 2)"
ITEMS = "items AS (SELECT p_partkey AS item_id, p_name AS title, replace(p_name, ' ', '|') || '|' || p_type AS genres FROM part)"
GENRES = ITEMS + ", parsed AS (SELECT item_id, title, list_distinct(list_filter(string_split(genres, '|'), lambda x: x <> '' AND x <> '(no genres listed)')) AS g FROM items)"
TOKENS = "tokens AS (SELECT DISTINCT doc_id AS item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents), doc_sets AS (SELECT * FROM tokens WHERE token <> '')"
PLACED = RATINGS + ", placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ratings), sized AS (SELECT *, greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS s FROM placed)"
SPLIT = PLACED + ", parts AS (SELECT user_id, item_id, r2, ts, CASE WHEN n < 3 THEN 'train' WHEN pos > n - s THEN 'test' WHEN pos > n - 2 * s THEN 'val' ELSE 'train' END AS split FROM sized), train AS (SELECT * FROM parts WHERE split = 'train'), val AS (SELECT * FROM parts WHERE split = 'val'), test AS (SELECT * FROM parts WHERE split = 'test'), users AS (SELECT DISTINCT user_id FROM ratings)"


def popular_sql(source: str) -> str:
    return f"pop AS (SELECT item_id, count(*) AS cnt FROM {source} GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, item_id) AS pop_rank FROM pop)"


def popular_recs_sql(seen: str, n: int = K) -> str:
    return f"poprecs AS (SELECT user_id, item_id, CAST(cnt AS DOUBLE) AS score, rank FROM (SELECT u.user_id, r.item_id, r.cnt, row_number() OVER (PARTITION BY u.user_id ORDER BY pop_rank) AS rank FROM users u CROSS JOIN ranked r WHERE NOT EXISTS (SELECT 1 FROM {seen} t WHERE t.user_id = u.user_id AND t.item_id = r.item_id)) WHERE rank <= {n})"


def filled_sql(recs: str, seen: str, n: int = K) -> str:
    """``recs`` (user_id, item_id, score, rank) filled up with popular items, as CTE filled."""
    return f"""have AS (SELECT user_id, count(*) AS h FROM {recs} GROUP BY 1),
more AS (SELECT u.user_id, r.item_id, coalesce(h, 0) AS h, row_number() OVER (PARTITION BY u.user_id ORDER BY pop_rank) AS nth FROM users u LEFT JOIN have USING (user_id) CROSS JOIN ranked r
  WHERE coalesce(h, 0) < {n} AND NOT EXISTS (SELECT 1 FROM {seen} t WHERE t.user_id = u.user_id AND t.item_id = r.item_id) AND NOT EXISTS (SELECT 1 FROM {recs} t WHERE t.user_id = u.user_id AND t.item_id = r.item_id)),
filled AS (SELECT user_id, item_id, CAST(score AS DOUBLE) AS score, rank FROM {recs} UNION ALL SELECT user_id, item_id, 0.0, h + nth FROM more WHERE h + nth <= {n})"""


def per_user_sql(recs: str, truth: str, k: int = K) -> str:
    return f"""per_user AS (SELECT t.user_id, coalesce(hits, 0) / CAST({k} AS DOUBLE) AS precision, coalesce(hits, 0) / CAST(n AS DOUBLE) AS recall, coalesce(gain, 0) / list_sum([1 / log2(i + 1) for i in range(1, CAST(least({k}, n) AS BIGINT) + 1)]) AS ndcg
  FROM (SELECT user_id, count(*) AS n FROM {truth} GROUP BY 1) t LEFT JOIN (SELECT r.user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS gain FROM {recs} r JOIN {truth} x ON r.user_id = x.user_id AND r.item_id = x.item_id WHERE rank <= {k} GROUP BY 1) h ON t.user_id = h.user_id)"""


def metrics_sql(recs: str, truth: str, catalogue: str, k: int = K, more: str = "") -> str:
    return f"""SELECT {more}CAST({k} AS BIGINT) AS k, count(*) AS users, coalesce(round(avg(precision), 6), 0) AS precision, coalesce(round(avg(recall), 6), 0) AS recall, coalesce(round(avg(ndcg), 6), 0) AS ndcg,
  (SELECT round(count(DISTINCT item_id) / CAST(({catalogue}) AS DOUBLE), 6) FROM {recs} WHERE rank <= {k}) AS coverage FROM per_user"""


def cosine_sql(source: str) -> str:
    return f"""norm AS (SELECT item_id, sum(r2 * r2) AS n2 FROM {source} GROUP BY 1),
dots AS (SELECT a.item_id AS a, b.item_id AS b, CAST(sum(a.r2 * b.r2) AS BIGINT) AS dot FROM {source} a JOIN {source} b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2),
cosines AS (SELECT a, b, dot, dot / sqrt(CAST(x.n2 AS DOUBLE) * CAST(y.n2 AS DOUBLE)) AS sim FROM dots JOIN norm x ON x.item_id = a JOIN norm y ON y.item_id = b)"""


def nearest_sql(source: str, k: int = NEIGHBOURS) -> str:
    return cosine_sql(source) + f""", both_ways AS (SELECT a, b, sim FROM cosines UNION ALL SELECT b, a, sim FROM cosines),
near AS (SELECT * FROM (SELECT a, b, CAST(round(sim * 1000000000) AS BIGINT) AS simq, row_number() OVER (PARTITION BY a ORDER BY CAST(round(sim * 1000000000) AS BIGINT) DESC, b) AS rank FROM both_ways) WHERE rank <= {k})"""


def item_cf_sql(r2: int, name: str = "cf", n: int = K) -> str:
    return f"""{name}_cand AS (SELECT l.user_id, x.b AS item_id, CAST(sum(simq) AS BIGINT) AS scoreq FROM train l JOIN near x ON x.a = l.item_id WHERE l.r2 >= {r2} AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = l.user_id AND t.item_id = x.b) GROUP BY 1, 2),
{name} AS (SELECT user_id, item_id, scoreq / CAST(1e9 AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scoreq DESC, item_id) AS rank FROM {name}_cand) WHERE rank <= {n})"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = written(split.three_way(tables.ratings(spark, sf_dir)).drop("rating"), "split")
    rows = rows.withColumn("rating", F.col("r2") / F.lit(2.0))
    return tuple(rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ratings(spark, sf_dir).select("user_id").distinct()


def _catalogue(spark: SparkSession, sf_dir: str) -> int:
    return tables.table(spark, sf_dir, "part").count()


# --- encoders, matrices, statistics ---------------------------------------------------------------------------


@query(f"WITH {RATINGS} SELECT user_id AS id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM ratings)")
def id_mapping_users(spark, sf_dir):
    return encode.id_map(tables.ratings(spark, sf_dir).select("user_id"))


@query(f"WITH {RATINGS}, ids AS (SELECT item_id AS id FROM ratings UNION SELECT p_partkey FROM part) SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM ids")
def id_mapping_items(spark, sf_dir):
    return encode.id_map(tables.ratings(spark, sf_dir).select("item_id"), tables.items(spark, sf_dir).select("item_id"))


@query(f"""WITH {RATINGS}, bu AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY 1), bi AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1)
SELECT (SELECT count(*) FROM bu) AS users, (SELECT count(*) FROM bi) AS items, (SELECT count(*) FROM ratings) AS interactions,
  round(1 - (SELECT count(*) FROM ratings) / (CAST((SELECT count(*) FROM bu) AS DOUBLE) * (SELECT count(*) FROM bi)), 9) AS sparsity,
  (SELECT user_id FROM bu ORDER BY n DESC, user_id LIMIT 1) AS busiest_user, (SELECT max(n) FROM bu) AS busiest_user_count,
  (SELECT item_id FROM bi ORDER BY n DESC, item_id LIMIT 1) AS top_item, (SELECT max(n) FROM bi) AS top_item_count""")
def dataset_stats(spark, sf_dir):
    return encode.statistics(tables.ratings(spark, sf_dir))


@query(f"WITH {RATINGS} SELECT user_id, item_id, CAST(sum(r2 / CAST(2 AS DOUBLE)) AS DOUBLE) AS value FROM ratings GROUP BY 1, 2")
def user_item_matrix(spark, sf_dir):
    return encode.matrix(tables.ratings(spark, sf_dir))


@query(f"WITH {RATINGS} SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS value FROM ratings GROUP BY 1, 2")
def user_item_binary(spark, sf_dir):
    return encode.matrix(tables.ratings(spark, sf_dir), binary=True)


@query(f"WITH {RATINGS} SELECT DISTINCT user_id, item_id FROM ratings")
def user_item_sets(spark, sf_dir):
    return encode.item_sets(tables.ratings(spark, sf_dir))


@query(f"WITH {RATINGS} SELECT user_id, count(*) AS n, string_agg(item_id || ':' || r2, ',' ORDER BY item_id) AS ratings FROM ratings GROUP BY 1")
def user_rating_lists(spark, sf_dir):
    lists = encode.rating_lists(tables.ratings(spark, sf_dir))
    listed = F.array_join(F.transform("ratings", lambda x: F.concat_ws(":", x["item_id"], (x["rating"] * 2).cast("long"))), ",")
    return lists.select("user_id", F.size("ratings").cast("long").alias("n"), listed.alias("ratings"))


@query(f"WITH {RATINGS}, m AS (SELECT user_id, item_id FROM ratings GROUP BY 1, 2), l AS (SELECT user_id, unnest(list(item_id)) AS item_id FROM ratings GROUP BY user_id) SELECT count(*) AS differing_pairs FROM ((SELECT * FROM m EXCEPT SELECT * FROM l) UNION ALL (SELECT * FROM l EXCEPT SELECT * FROM m))")
def adjacency_check(spark, sf_dir):
    return encode.adjacency_differs(tables.ratings(spark, sf_dir)).agg(F.count("*").alias("differing_pairs"))


# --- splits ---------------------------------------------------------------------------------------------------


@query(f"WITH {PLACED} SELECT user_id, item_id, CASE WHEN n > 1 AND pos > n - s THEN 'test' ELSE 'train' END AS split FROM sized")
def temporal_split_2way(spark, sf_dir):
    return split.two_way(tables.ratings(spark, sf_dir)).select("user_id", "item_id", "split")


@query(f"WITH {SPLIT} SELECT user_id, item_id, split FROM parts")
def temporal_split_3way(spark, sf_dir):
    return split.three_way(tables.ratings(spark, sf_dir)).select("user_id", "item_id", "split")


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, CAST(sum(user_id * 31 + item_id * 7 + r2) AS BIGINT) AS checksum FROM parts GROUP BY 1")
def split_sizes(spark, sf_dir):
    rows = split.three_way(tables.ratings(spark, sf_dir))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("user_id") * 31 + F.col("item_id") * 7 + F.col("r2")).alias("checksum"))


@query(f"WITH {SPLIT}, a AS (SELECT user_id, max(ts) AS last FROM train GROUP BY 1), b AS (SELECT user_id, min(ts) AS first FROM (SELECT * FROM val UNION ALL SELECT * FROM test) GROUP BY 1) SELECT count(*) AS leaking_users FROM a JOIN b USING (user_id) WHERE last > first")
def verify_temporal_order(spark, sf_dir):
    train, val, test = _parts(spark, sf_dir)
    return split.leaks(train, val.unionByName(test)).agg(F.count("*").alias("leaking_users"))


# --- popularity -----------------------------------------------------------------------------------------------


@query(f"WITH {SPLIT}, {popular_sql('train')} SELECT item_id, cnt FROM pop")
def popularity_counts(spark, sf_dir):
    return popularity.counts(_parts(spark, sf_dir)[0])


@query(f"WITH {SPLIT}, {popular_sql('train')} SELECT item_id, cnt, pop_rank FROM ranked")
def popularity_rank(spark, sf_dir):
    return popularity.ranks(popularity.counts(_parts(spark, sf_dir)[0]))


def _popular_recs(spark, sf_dir, n=K):
    train, _, test = _parts(spark, sf_dir)
    return popularity.recommend(_users(spark, sf_dir), train, popularity.counts(train), n), test


@query(f"WITH {SPLIT}, {popular_sql('train')}, {popular_recs_sql('train')} SELECT user_id, item_id, score, rank FROM poprecs")
def popularity_recs(spark, sf_dir):
    return _popular_recs(spark, sf_dir)[0]


@query(f"WITH {SPLIT}, {popular_sql('train')}, {popular_recs_sql('train')}, {per_user_sql('poprecs', 'test')} {metrics_sql('poprecs', 'test', 'SELECT count(*) FROM part')}")
def popularity_metrics(spark, sf_dir):
    recs, test = _popular_recs(spark, sf_dir)
    return ranking.evaluate(recs, test, _catalogue(spark, sf_dir), K)


@query(f"WITH {SPLIT}, {popular_sql('train')}, {popular_recs_sql('train', 20)}, truth AS (SELECT user_id, count(*) AS n FROM test GROUP BY 1), ks AS (SELECT unnest(range(1, 21)) AS k), hit AS (SELECT r.user_id, r.rank FROM poprecs r JOIN test x ON r.user_id = x.user_id AND r.item_id = x.item_id), e AS (SELECT k, t.user_id, n, count(h.rank) AS hits, coalesce(sum(1 / log2(h.rank + 1)), 0) AS gain FROM ks CROSS JOIN truth t LEFT JOIN hit h ON h.user_id = t.user_id AND h.rank <= k GROUP BY 1, 2, 3) SELECT k, count(*) AS users, round(avg(hits / CAST(k AS DOUBLE)), 6) AS precision, round(avg(hits / CAST(n AS DOUBLE)), 6) AS recall, round(avg(gain / list_sum([1 / log2(i + 1) for i in range(1, least(k, n) + 1)])), 6) AS ndcg FROM e GROUP BY k")
def popularity_k_sweep(spark, sf_dir):
    recs, test = _popular_recs(spark, sf_dir, 20)
    return ranking.sweep_ks(recs, test, list(range(1, 21)))


PER_USER = f"WITH {SPLIT}, {popular_sql('train')}, {popular_recs_sql('train')}, {per_user_sql('poprecs', 'test')}"


@query(f"{PER_USER} SELECT user_id, round(precision, 6) AS precision FROM per_user")
def precision_at_k(spark, sf_dir):
    return ranking.per_user(*_popular_recs(spark, sf_dir), K).select("user_id", F.round("precision", 6).alias("precision"))


@query(f"{PER_USER} SELECT user_id, round(recall, 6) AS recall FROM per_user")
def recall_at_k(spark, sf_dir):
    return ranking.per_user(*_popular_recs(spark, sf_dir), K).select("user_id", F.round("recall", 6).alias("recall"))


@query(f"{PER_USER} SELECT user_id, round(ndcg, 6) AS ndcg FROM per_user")
def ndcg_at_k(spark, sf_dir):
    return ranking.per_user(*_popular_recs(spark, sf_dir), K).select("user_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"{PER_USER} SELECT count(DISTINCT item_id) AS covered, round(count(DISTINCT item_id) / CAST((SELECT count(*) FROM part) AS DOUBLE), 6) AS coverage FROM poprecs")
def catalog_coverage(spark, sf_dir):
    recs, n = _popular_recs(spark, sf_dir)[0], _catalogue(spark, sf_dir)
    return recs.agg(F.countDistinct("item_id").alias("covered"), F.round(F.countDistinct("item_id") / F.lit(float(n)), 6).alias("coverage"))


# --- item similarity and collaborative filtering --------------------------------------------------------------


@query(f"WITH {RATINGS} SELECT item_id, CAST(sum(r2 * r2) AS BIGINT) AS norm2 FROM ratings GROUP BY 1")
def item_norms(spark, sf_dir):
    return similarity.norms(tables.ratings(spark, sf_dir))


@query(f"WITH {RATINGS}, {cosine_sql('ratings')} SELECT a, b, dot, CAST(round(sim * 1000000000) AS BIGINT) AS simq FROM cosines")
def item_cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(tables.ratings(spark, sf_dir)).select("a", "b", "dot", F.round(F.col("sim") * similarity.SCALE).cast("long").alias("simq"))


@query(f"WITH {RATINGS}, {nearest_sql('ratings')} SELECT a, b, simq, rank FROM near")
def item_knn_top20(spark, sf_dir):
    return similarity.nearest_cosine(tables.ratings(spark, sf_dir), NEIGHBOURS).select("a", "b", "simq", "rank")


@query(f"WITH {SPLIT} SELECT user_id, item_id, r2 FROM train WHERE r2 >= 7")
def liked_items(spark, sf_dir):
    return recommend.liked(_parts(spark, sf_dir)[0], 3.5).select("user_id", "item_id", "r2")


def _near(train: DataFrame) -> DataFrame:
    return written(similarity.nearest_cosine(train, NEIGHBOURS), "near")


CF = f"WITH {SPLIT}, {nearest_sql('train')}, {popular_sql('train')}"


@query(f"{CF}, {item_cf_sql(7)} SELECT user_id, item_id, scoreq FROM cf_cand")
def item_cf_candidates(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    return recommend.candidates(recommend.liked(train, 3.5), _near(train), train)


@query(f"{CF}, {item_cf_sql(7)} SELECT user_id, item_id, score, rank FROM cf")
def item_cf_recs(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    return recommend.item_cf(recommend.liked(train, 3.5), _near(train), train, K)


@query(f"{CF}, {item_cf_sql(8)}, {filled_sql('cf', 'train')} SELECT user_id, item_id, score, rank FROM filled")
def item_cf_recs_fallback(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    return recommend.item_cf_filled(train, _near(train), _users(spark, sf_dir), popularity.counts(train), 4.0, K)


def _sweep(spark, sf_dir):
    train, val, _ = _parts(spark, sf_dir)
    return recommend.threshold_sweep(train, _near(train), _users(spark, sf_dir), popularity.counts(train), val, _catalogue(spark, sf_dir))


def _sweep_sql() -> str:
    rows = []
    for t in (0.0, 3.0, 3.5, 4.0):
        rows.append(f"SELECT * FROM (WITH {item_cf_sql(int(2 * t))}, {filled_sql('cf', 'train')}, {per_user_sql('filled', 'val')} {metrics_sql('filled', 'val', 'SELECT count(*) FROM part', K, f'CAST({t} AS DOUBLE) AS threshold, ')})")
    return f"{CF}, sweep AS ({' UNION ALL '.join(rows)})"


@query(f"{_sweep_sql()} SELECT * FROM sweep")
def item_cf_threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(f"{_sweep_sql()} SELECT * FROM sweep ORDER BY ndcg DESC, recall DESC, precision DESC, threshold LIMIT 1")
def item_cf_best_threshold(spark, sf_dir):
    return ranking.best(_sweep(spark, sf_dir), "ndcg", "recall", "precision")


# --- Jaccard, MinHash, LSH ------------------------------------------------------------------------------------


def _item_users(spark, sf_dir):
    return tables.ratings(spark, sf_dir).select("item_id", F.col("user_id").alias("token"))


JACCARD = f"""WITH {RATINGS}, n AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1), sh AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2),
jac AS (SELECT a, b, shared, shared / CAST(x.n + y.n - shared AS DOUBLE) AS sim FROM sh JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b)"""


@query(f"{JACCARD} SELECT a, b, shared, CAST(round(sim * 1000000000) AS BIGINT) AS simq FROM jac")
def jaccard_exact_pairs(spark, sf_dir):
    return similarity.jaccard_pairs(_item_users(spark, sf_dir)).select("a", "b", "shared", F.round(F.col("sim") * similarity.SCALE).cast("long").alias("simq"))


@query(f"""{JACCARD}, two AS (SELECT a, b, sim FROM jac UNION ALL SELECT b, a, sim FROM jac)
SELECT a, b, simq, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY simq DESC, b) AS rank FROM (SELECT a, b, CAST(round(sim * 1000000000) AS BIGINT) AS simq FROM two)) WHERE rank <= 20""")
def jaccard_exact_topk(spark, sf_dir):
    return similarity.nearest_jaccard(_item_users(spark, sf_dir), 20).select("a", "b", "simq", "rank")


DOC_JACCARD = f"""{TOKENS}, n AS (SELECT item_id, count(*) AS n FROM doc_sets GROUP BY 1), sh AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM doc_sets a JOIN doc_sets b ON a.token = b.token AND a.item_id < b.item_id GROUP BY 1, 2),
jac AS (SELECT a, b, shared, shared / CAST(x.n + y.n - shared AS DOUBLE) AS sim FROM sh JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b)"""


@query(f"WITH {DOC_JACCARD} SELECT a, b, shared, round(sim, 6) AS sim FROM jac WHERE sim >= 0.5")
def jaccard_threshold_pairs(spark, sf_dir):
    return similarity.jaccard_at_least(tables.doc_sets(spark, sf_dir), 0.5).select("a", "b", "shared", F.round("sim", 6).alias("sim"))


NUM_PERM = 128
BANDS = {0.5: (25, 5), 0.3: (37, 3), 0.2: (28, 2)}  # what lsh.band_shape gives; a test holds them to it


def _signature_sql() -> str:
    mins = ", ".join(f"min((h * {a} + {b}) % {lsh.PRIME})" for a, b in lsh.permutations(NUM_PERM))
    return f"{TOKENS}, hashed AS (SELECT item_id, CAST('0x' || substr(md5(token), 1, 7) AS BIGINT) AS h FROM doc_sets), sigs AS (SELECT item_id, [{mins}] AS sig FROM hashed GROUP BY 1)"


def _lsh_sql(threshold: float) -> str:
    bands, rows = BANDS[threshold]
    return f"""bkt AS (SELECT item_id, band, array_to_string(sig[band * {rows} + 1 : band * {rows} + {rows}], ',') AS key FROM sigs CROSS JOIN (SELECT unnest(range({bands})) AS band)),
cand AS (SELECT DISTINCT x.item_id AS a, y.item_id AS b FROM bkt x JOIN bkt y ON x.band = y.band AND x.key = y.key AND x.item_id < y.item_id)"""


def _lsh_row_sql(threshold: float) -> str:
    return f"""SELECT CAST({threshold} AS DOUBLE) AS threshold, c AS candidate_pairs, al AS all_pairs, round(100.0 * c / CAST(al AS DOUBLE), 6) AS comparisons_pct, t AS true_pairs, h AS hits, CASE WHEN t > 0 THEN round(h / CAST(t AS DOUBLE), 6) ELSE 1.0 END AS recall, CASE WHEN c > 0 THEN round(al / CAST(c AS DOUBLE), 6) END AS pair_reduction_x
FROM (SELECT (SELECT count(*) FROM cand) AS c, (SELECT CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) FROM n) AS al, (SELECT count(*) FROM jac WHERE sim >= {threshold}) AS t, (SELECT count(*) FROM cand JOIN jac USING (a, b) WHERE sim >= {threshold}) AS h)"""


def _signatures(spark, sf_dir):
    return written(lsh.signatures(tables.doc_tokens(spark, sf_dir), NUM_PERM), "sigs")


@query(f"WITH {_signature_sql()} SELECT item_id, array_to_string(sig, ',') AS sig FROM sigs")
def minhash_signatures(spark, sf_dir):
    return lsh.signatures(tables.doc_tokens(spark, sf_dir), NUM_PERM).select("item_id", F.array_join("sig", ",").alias("sig"))


@query(f"WITH {_signature_sql()}, {_lsh_sql(0.5)} SELECT a, b FROM cand")
def lsh_candidate_pairs(spark, sf_dir):
    return lsh.candidate_pairs(lsh.buckets(_signatures(spark, sf_dir), *BANDS[0.5]))


@query(f"WITH {DOC_JACCARD}, {_signature_sql().removeprefix(TOKENS + ', ')}, {_lsh_sql(0.5)} SELECT a, b, round(sim, 6) AS sim FROM cand JOIN jac USING (a, b) WHERE sim >= 0.5")
def lsh_verified_pairs(spark, sf_dir):
    pairs = lsh.candidate_pairs(lsh.buckets(_signatures(spark, sf_dir), *BANDS[0.5]))
    return lsh.verified(pairs, tables.doc_tokens(spark, sf_dir)).where("sim >= 0.5").select("a", "b", F.round("sim", 6).alias("sim"))


def _lsh_rows(spark, sf_dir, *thresholds):
    """A row a threshold; the exact pairs of the least one hold those of all."""
    exact = written(similarity.jaccard_at_least(tables.doc_sets(spark, sf_dir), min(thresholds)), "exact")
    sigs, out = _signatures(spark, sf_dir), None
    for t in thresholds:
        row = written(lsh.counted_recall(sigs, exact, *BANDS[t], t), "row")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {DOC_JACCARD}, {_signature_sql().removeprefix(TOKENS + ', ')}, {_lsh_sql(0.5)} {_lsh_row_sql(0.5)}")
def lsh_recall(spark, sf_dir):
    return _lsh_rows(spark, sf_dir, 0.5)


@query(f"WITH {DOC_JACCARD}, {_signature_sql().removeprefix(TOKENS + ', ')} " + " UNION ALL ".join(f"SELECT * FROM (WITH {_lsh_sql(t)} {_lsh_row_sql(t)})" for t in BANDS))
def lsh_threshold_benchmark(spark, sf_dir):
    return _lsh_benchmark(spark, sf_dir)


def _lsh_benchmark(spark, sf_dir):
    return _lsh_rows(spark, sf_dir, *BANDS)


@query(f"WITH {DOC_JACCARD}, {_signature_sql().removeprefix(TOKENS + ', ')} SELECT *, round(recall * pair_reduction_x, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM (WITH {_lsh_sql(t)} {_lsh_row_sql(t)})" for t in BANDS) + ") ORDER BY score DESC, threshold LIMIT 1")
def lsh_best_threshold(spark, sf_dir):
    """Recall for the pairs looked at; the runner's table has recall for the seconds, which no two runs share."""
    return ranking.best(_lsh_benchmark(spark, sf_dir).withColumn("score", F.round(F.col("recall") * F.col("pair_reduction_x"), 6)), "score")


# --- factors --------------------------------------------------------------------------------------------------


def _power_sql(rounds: int = 3) -> str:
    parts = [f"{EVENTS}", "v0 AS (SELECT DISTINCT item_id, CAST(1 AS DOUBLE) AS v FROM ev)"]
    for i in range(rounds):
        parts.append(f"u{i} AS (SELECT user_id, sum(value * v) AS u FROM ev JOIN v{i} USING (item_id) GROUP BY 1)")
        parts.append(f"w{i} AS (SELECT item_id, sum(value * u) AS w FROM ev JOIN u{i} USING (user_id) GROUP BY 1)")
        parts.append(f"v{i + 1} AS (SELECT item_id, w / (SELECT sqrt(sum(w * w)) FROM w{i}) AS v FROM w{i})")
    return f"WITH {', '.join(parts)} SELECT item_id, round(v, 4) AS v FROM v{rounds}"


@query(_power_sql(8))
def svd_power_rank1(spark, sf_dir):
    """The first item factor; ratings are positive, so that its entries have one sign."""
    _, things, _ = factor.svd(tables.event_ratings(spark, sf_dir), 1, value="value")
    return things.select("item_id", F.round(F.abs(F.col("vector")[0]), 4).alias("v"))


@query()
def svd_topk_recs(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    users, things, _ = factor.svd(train, 50)
    return popularity.fill(factor.recommend(users, things, train, K), _users(spark, sf_dir), train, popularity.counts(train), K)


@query()
def svd_factor_sweep(spark, sf_dir):
    train, val, _ = _parts(spark, sf_dir)
    users, things, _ = factor.svd(train, 200)
    ks, out, n = [10, 20, 50, 100, 150, 200], None, _catalogue(spark, sf_dir)
    recs = factor.recommend_widths(users, things, train, ks, K)
    for k in ks:
        row = ranking.evaluate(recs.where(F.col("factors") == k).drop("factors"), val, n, K).select(F.lit(k).cast("long").alias("factors"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def svd_best_factors(spark, sf_dir):
    return ranking.best(svd_factor_sweep(spark, sf_dir), "recall", "ndcg", "precision")


@query("""SELECT user_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
SELECT a.vec_id AS user_id, b.vec_id AS item_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a CROSS JOIN embeddings b)) WHERE rank <= 10""")
def factor_dot_topk(spark, sf_dir):
    rows = tables.factors(spark, sf_dir).select("item_id", "vector")
    return factor.dot_top(rows.withColumnRenamed("item_id", "user_id"), rows, 10).select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {RATINGS}, sup AS (SELECT item_id FROM ratings GROUP BY 1 HAVING count(*) >= 15), f AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM f WHERE item_id = 1),
s AS (SELECT item_id, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) AS similarity FROM f CROSS JOIN q WHERE item_id <> 1 AND item_id IN (SELECT item_id FROM sup))
SELECT item_id, similarity, row_number() OVER (ORDER BY similarity DESC, item_id) AS rank FROM s ORDER BY similarity DESC, item_id LIMIT 4""")
def factor_nearest_items(spark, sf_dir):
    return factor.nearest_items(tables.factors(spark, sf_dir), 1, popularity.counts(tables.ratings(spark, sf_dir)))


# --- graph ----------------------------------------------------------------------------------------------------

GRAPH = f"WITH {EVENTS}, g AS (SELECT DISTINCT user_id, item_id FROM ev), users AS (SELECT DISTINCT user_id FROM g), {popular_sql('g')}"
HOPS = "hop AS (SELECT DISTINCT a.user_id, b.user_id AS other FROM g a JOIN g b USING (item_id)), reach AS (SELECT h.user_id, e.item_id, count(*) AS score FROM hop h JOIN g e ON e.user_id = h.other WHERE NOT EXISTS (SELECT 1 FROM g t WHERE t.user_id = h.user_id AND t.item_id = e.item_id) GROUP BY 1, 2)"


def _graph(spark, sf_dir):
    return written(graph.edges(tables.event_ratings(spark, sf_dir)), "edges")


@query(f"{GRAPH} SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS edges FROM g")
def graph_stats(spark, sf_dir):
    return graph.statistics(_graph(spark, sf_dir))


@query(f"{GRAPH} SELECT user_id, item_id FROM g")
def bipartite_edges(spark, sf_dir):
    return graph.edges(tables.event_ratings(spark, sf_dir))


@query(f"{GRAPH}, {HOPS} SELECT user_id, item_id, score FROM reach")
def bfs_3hop_counts(spark, sf_dir):
    return graph.three_hop(_graph(spark, sf_dir))


@query(f"{GRAPH}, {HOPS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM reach) WHERE rank <= 10), {filled_sql('top', 'g')} SELECT user_id, item_id, score, rank FROM filled")
def bfs_recs(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return graph.bfs_recommend(g, g.select("user_id").distinct(), popularity.counts(g), K)


def _ppr_sql() -> str:
    parts = ["du AS (SELECT user_id, count(*) AS d FROM g GROUP BY 1)", "di AS (SELECT item_id, count(*) AS d FROM g GROUP BY 1)", "p0 AS (SELECT user_id AS seed, user_id, CAST(1 AS DOUBLE) AS p FROM users)"]
    for t in range(5):
        parts.append(f"m{t} AS (SELECT seed, g.item_id, sum(p / d) AS p FROM p{t} JOIN du USING (user_id) JOIN g USING (user_id) GROUP BY 1, 2)")
        parts.append(f"p{t + 1} AS (SELECT seed, g.user_id, sum(p / d) AS p FROM m{t} JOIN di USING (item_id) JOIN g USING (item_id) GROUP BY 1, 2)")
    terms = " UNION ALL ".join(f"SELECT seed, item_id, p * CAST({(1 - 0.85) * 0.85 ** (2 * t + 1)!r} AS DOUBLE) AS s FROM m{t}" for t in range(5))
    return f"{GRAPH}, {', '.join(parts)}, ppr AS (SELECT seed, item_id, sum(s) AS score FROM ({terms}) GROUP BY 1, 2)"


@query(f"{_ppr_sql()} SELECT seed, item_id, round(score, 9) AS score FROM ppr")
def ppr_scores(spark, sf_dir):
    return graph.page_rank(_graph(spark, sf_dir)).select("seed", "item_id", F.round("score", 9).alias("score"))


@query(f"{_ppr_sql()}, top AS (SELECT * FROM (SELECT seed AS user_id, item_id, round(score, 9) AS score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, item_id) AS rank FROM ppr WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM g t WHERE t.user_id = seed AND t.item_id = ppr.item_id)) WHERE rank <= 10), {filled_sql('top', 'g')} SELECT user_id, item_id, score, rank FROM filled")
def ppr_recs(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return graph.ppr_recommend(graph.page_rank(g), g, g.select("user_id").distinct(), popularity.counts(g), K)


def _cluster_sql(threshold: float) -> str:
    """Components of pairs at the threshold, as CTE clu (item_id, component): the least item that is reachable."""
    return f"""e AS (SELECT a, b FROM jac WHERE sim >= {threshold} UNION SELECT b, a FROM jac WHERE sim >= {threshold}),
walk AS (SELECT item_id, item_id AS reached FROM n UNION SELECT w.item_id, e.b FROM walk w JOIN e ON e.a = w.reached),
clu AS (SELECT item_id, min(reached) AS component FROM walk GROUP BY 1)"""


QUALITY = """lab AS (SELECT component, coalesce(lang, 'unknown') AS label, count(*) AS c FROM clu LEFT JOIN documents ON doc_id = item_id GROUP BY 1, 2),
each AS (SELECT component, sum(c) AS size, max(c) AS top FROM lab GROUP BY 1),
ent AS (SELECT component, sum(-(c / CAST(size AS DOUBLE)) * log2(c / CAST(size AS DOUBLE))) AS entropy FROM lab JOIN each USING (component) GROUP BY 1),
tot AS (SELECT CAST(sum(size) AS DOUBLE) AS items, CAST(count(*) AS DOUBLE) AS num_clusters, CAST(count(*) FILTER (WHERE size > 1) AS DOUBLE) AS several, CAST(max(size) AS DOUBLE) AS largest, coalesce(CAST(sum(size) FILTER (WHERE size > 1) AS DOUBLE), 0) AS clustered, CAST(sum(top) FILTER (WHERE size > 1) AS DOUBLE) AS pure, sum(size * entropy) FILTER (WHERE size > 1) AS mixed FROM each JOIN ent USING (component))"""
QUALITY_ROW = "coalesce(round(pure / nullif(clustered, 0), 6), 0) AS purity, coalesce(round(mixed / nullif(clustered, 0), 6), 0) AS entropy, round(clustered / items, 6) AS clustered_ratio, round(largest / items, 6) AS largest_component_ratio, num_clusters, several AS num_non_singleton_clusters, largest AS largest_cluster_size, round(coalesce(pure / nullif(clustered, 0), 0) * (clustered / items) * (1 - largest / items), 6) AS selection_score FROM tot"


def _clusters(spark, sf_dir, threshold, pairs=None):
    sets = tables.doc_sets(spark, sf_dir)
    pairs = pairs if pairs is not None else similarity.jaccard_at_least(sets, threshold, expand=False)
    return graph.clusters(pairs, sets.select("item_id").distinct(), threshold)


def _labels(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("label"))


@query(f"WITH RECURSIVE {DOC_JACCARD}, {_cluster_sql(0.5)} SELECT item_id, component FROM clu")
def similarity_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir, 0.5)


@query(f"WITH RECURSIVE {DOC_JACCARD}, {_cluster_sql(0.5)}, {QUALITY} SELECT {QUALITY_ROW}")
def cluster_quality(spark, sf_dir):
    return graph.cluster_quality(_clusters(spark, sf_dir, 0.5), _labels(spark, sf_dir))


CLUSTER_ROWS = " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_cluster_sql(t)}, {QUALITY} SELECT CAST({t} AS DOUBLE) AS threshold, {QUALITY_ROW})" for t in (0.5, 0.6, 0.7, 0.8))


def _cluster_sweep(spark, sf_dir):
    pairs, out = written(similarity.jaccard_at_least(tables.doc_sets(spark, sf_dir), 0.5, expand=False), "pairs"), None
    for t in (0.5, 0.6, 0.7, 0.8):
        row = graph.cluster_quality(_clusters(spark, sf_dir, t, pairs), _labels(spark, sf_dir)).select(F.lit(t).alias("threshold"), "*")
        row = written(row, "row")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH RECURSIVE {DOC_JACCARD} {CLUSTER_ROWS}")
def cluster_threshold_sweep(spark, sf_dir):
    return _cluster_sweep(spark, sf_dir)


@query(f"WITH RECURSIVE {DOC_JACCARD} SELECT * FROM ({CLUSTER_ROWS}) ORDER BY selection_score DESC, threshold LIMIT 1")
def cluster_best_threshold(spark, sf_dir):
    return ranking.best(_cluster_sweep(spark, sf_dir), "selection_score")


@query(f"""WITH RECURSIVE {DOC_JACCARD}, {_cluster_sql(0.5)}, lab AS (SELECT component, coalesce(lang, 'unknown') AS label, count(*) AS c FROM clu LEFT JOIN documents ON doc_id = item_id GROUP BY 1, 2)
SELECT component, CAST(sum(c) AS BIGINT) AS size, (SELECT string_agg(item_id, ',' ORDER BY item_id) FROM (SELECT item_id FROM clu WHERE clu.component = lab.component ORDER BY item_id LIMIT 5)) AS members, arg_min(label, (-c, label)) AS label
FROM lab GROUP BY component ORDER BY size DESC, component LIMIT 5""")
def cluster_examples(spark, sf_dir):
    return graph.cluster_examples(_clusters(spark, sf_dir, 0.5), _labels(spark, sf_dir))


# --- genres, diversity, cold start ----------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT item_id, array_to_string(list_filter(string_split(genres, '|'), lambda x: x <> '' AND x <> '(no genres listed)'), ',') AS genres, len(list_filter(string_split(genres, '|'), lambda x: x <> '' AND x <> '(no genres listed)')) AS n FROM items")
def genre_parse(spark, sf_dir):
    parsed = genres.parse(F.col("genres"))
    return tables.items(spark, sf_dir).select("item_id", F.array_join(parsed, ",").alias("genres"), F.size(parsed).cast("long").alias("n"))


@query(f"WITH {ITEMS} SELECT item_id, CASE WHEN string_split(genres, '|')[1] IN ('(no genres listed)', '') THEN 'unknown' ELSE string_split(genres, '|')[1] END AS label FROM items")
def primary_genre(spark, sf_dir):
    return tables.items(spark, sf_dir).select("item_id", genres.primary(F.col("genres")).alias("label"))


@query(f"WITH {GENRES}, voc AS (SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS idx FROM (SELECT DISTINCT unnest(g) AS genre FROM parsed)), x AS (SELECT item_id, unnest(g) AS genre, 1 / sqrt(CAST(len(g) AS DOUBLE)) AS weight FROM parsed) SELECT item_id, genre, idx, round(weight, 9) AS weight FROM x JOIN voc USING (genre)")
def genre_multihot(spark, sf_dir):
    return genres.vectors(tables.items(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {GENRES}, voc AS (SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS idx FROM (SELECT DISTINCT unnest(g) AS genre FROM parsed)) SELECT genre, idx, CAST(genre IN ('hot', 'bolt', 'no such genre') AS INTEGER) AS value FROM voc")
def genre_encode(spark, sf_dir):
    return genres.encode([*WANTED_GENRES, "no such genre"], genres.vocabulary(tables.items(spark, sf_dir)))


@query(f"{PER_USER} SELECT user_id, item_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 9) AS score FROM (SELECT *, min(score) OVER (PARTITION BY user_id) AS lo, max(score) OVER (PARTITION BY user_id) AS hi FROM poprecs)")
def minmax_normalized_scores(spark, sf_dir):
    return ranking.normalised(_popular_recs(spark, sf_dir)[0]).select("user_id", "item_id", F.round("score", 9).alias("score"))


GENRE_COSINE = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / sqrt(CAST(len({a}) * len({b}) AS DOUBLE)) ELSE 0.0 END"


def _mmr_sql(weight: float, n: int) -> str:
    parts = ["pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scoreq DESC, item_id) AS r FROM cf_cand) WHERE r <= 50)"]
    parts.append("c0 AS (SELECT user_id, item_id, g, CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END AS rel, CAST(0 AS DOUBLE) AS worst, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS DOUBLE) AS gain FROM (SELECT user_id, item_id, scoreq / CAST(1e9 AS DOUBLE) AS s, min(scoreq / CAST(1e9 AS DOUBLE)) OVER (PARTITION BY user_id) AS lo, max(scoreq / CAST(1e9 AS DOUBLE)) OVER (PARTITION BY user_id) AS hi FROM pool) JOIN parsed USING (item_id))")
    for i in range(1, n + 1):
        gain = "rel" if i == 1 else f"CAST({weight} AS DOUBLE) * rel - CAST({1 - weight!r} AS DOUBLE) * worst"
        parts.append(f"s{i} AS (SELECT *, CASE WHEN rank IS NULL THEN round({gain}, 9) END AS now FROM c{i - 1})")
        parts.append(f"b{i} AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY now DESC NULLS LAST, rel DESC, item_id) = 1 AND now IS NOT NULL AS best FROM s{i})")
        parts.append(f"h{i} AS (SELECT user_id, g AS hg FROM b{i} WHERE best)")
        parts.append(f"c{i} AS (SELECT user_id, item_id, g, rel, greatest(worst, {GENRE_COSINE.format(a='g', b='hg')}) AS worst, CASE WHEN best THEN {i} ELSE rank END AS rank, CASE WHEN best THEN now ELSE gain END AS gain FROM b{i} JOIN h{i} USING (user_id))")
    return f"{CF}, {GENRES}, {item_cf_sql(0)}, {', '.join(parts)} SELECT user_id, item_id, round(gain, 6) AS score, CAST(rank AS BIGINT) AS rank FROM c{n} WHERE rank IS NOT NULL"


def _scored(spark, sf_dir):
    """The 50 best candidates of each user, which are the pool of re-ranking, and the split."""
    train, val, test = _parts(spark, sf_dir)
    scores = recommend.item_cf(recommend.liked(train, 0.0), _near(train), train, 50).drop("rank")
    return written(scores, "scored"), train, val, test


@query(_mmr_sql(0.3, 5))
def mmr_rerank(spark, sf_dir):
    scores, train, _, _ = _scored(spark, sf_dir)
    return diversity.mmr(diversity.pool(scores, train), tables.items(spark, sf_dir), 0.3, 5).select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(_mmr_sql(0.5, 3))
def mmr_rerank_native(spark, sf_dir):
    scores, train, _, _ = _scored(spark, sf_dir)
    return diversity.mmr_native(diversity.pool(scores, train), tables.items(spark, sf_dir), 0.5, 3).select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query()
def mmr_lambda_sweep(spark, sf_dir):
    scores, train, val, _ = _scored(spark, sf_dir)
    popular, users, things, out = written(popularity.counts(train), "popular"), written(_users(spark, sf_dir), "users"), tables.items(spark, sf_dir), None
    for weight in (None, 0.3, 0.5, 0.7):  # a row is written before the next is planned
        row = diversity.evaluate_mmr(scores, train, val, things, popular, users, things.count(), weight).select(F.lit(weight).cast("double").alias("weight"), "*")
        row = written(row, "row")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def mmr_best_weight(spark, sf_dir):
    return ranking.best(mmr_lambda_sweep(spark, sf_dir).where("weight is not null"), "utility")


DIVERSITY = f"""div AS (SELECT user_id, CASE WHEN count(d) > 0 THEN avg(d) ELSE 0 END AS diversity FROM (SELECT x.user_id, 1 - {GENRE_COSINE.format(a='p.g', b='q.g')} AS d FROM poprecs x JOIN poprecs y ON x.user_id = y.user_id AND x.rank < y.rank JOIN parsed p ON p.item_id = x.item_id JOIN parsed q ON q.item_id = y.item_id) GROUP BY 1)"""
NOVELTY = "nov AS (SELECT user_id, avg(-log2(greatest(CAST(coalesce(cnt, 0) AS DOUBLE), 1e-9) / CAST((SELECT count(*) FROM users) AS DOUBLE))) AS novelty FROM poprecs LEFT JOIN pop USING (item_id) GROUP BY 1)"


@query(f"{PER_USER}, {GENRES}, {DIVERSITY} SELECT user_id, round(diversity, 6) AS diversity FROM div")
def intra_list_diversity(spark, sf_dir):
    return diversity.intra_list(_popular_recs(spark, sf_dir)[0], tables.items(spark, sf_dir)).withColumn("diversity", F.round("diversity", 6))


@query(f"{PER_USER}, {NOVELTY} SELECT user_id, round(novelty, 6) AS novelty FROM nov")
def novelty(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    popular, users = popularity.counts(train), _users(spark, sf_dir)
    return diversity.novelty(popularity.recommend(users, train, popular, K), popular, users.count()).withColumn("novelty", F.round("novelty", 6))


@query(f"""{PER_USER}, {GENRES}, {DIVERSITY}, {NOVELTY}, m AS ({metrics_sql('poprecs', 'test', 'SELECT count(*) FROM part')}), d AS (SELECT round(avg(diversity), 6) AS diversity FROM div), v AS (SELECT round(avg(novelty), 6) AS novelty FROM nov)
SELECT *, round(ndcg + diversity, 6) AS utility FROM m CROSS JOIN d CROSS JOIN v""")
def mmr_utility(spark, sf_dir):
    train, _, test = _parts(spark, sf_dir)
    popular, users, things = popularity.counts(train), _users(spark, sf_dir), tables.items(spark, sf_dir)
    return diversity.bundle(popularity.recommend(users, train, popular, K), test, things, popular, users, things.count(), K)


def _cold_sql(wanted: str, where: str) -> str:
    return f"""cold AS (SELECT item_id, title, len(list_intersect(g, w)) AS overlap, round(len(list_intersect(g, w)) / CAST(len(list_distinct(list_concat(g, w))) AS DOUBLE), 6) AS jaccard, coalesce(cnt, 0) AS popularity FROM parsed CROSS JOIN ({wanted}) LEFT JOIN pop USING (item_id) WHERE {where} AND len(list_intersect(g, w)) > 0 ORDER BY overlap DESC, jaccard DESC, popularity DESC, title, item_id LIMIT 10)"""


LIKED = "('" + "', '".join(LIKED_TITLES) + "')"
COLD_USER = _cold_sql(f"SELECT list(DISTINCT x) AS w FROM (SELECT unnest(g) AS x FROM parsed WHERE title IN {LIKED})", f"title NOT IN {LIKED}")
COLD_ITEM = _cold_sql(f"SELECT {WANTED_GENRES} AS w", "true")


def _all_popular(spark, sf_dir):
    return popularity.counts(tables.ratings(spark, sf_dir))


@query(f"WITH {RATINGS}, {popular_sql('ratings')}, {GENRES}, {COLD_USER} SELECT * FROM cold")
def coldstart_new_user(spark, sf_dir):
    return coldstart.for_new_user(tables.items(spark, sf_dir), LIKED_TITLES, _all_popular(spark, sf_dir))


@query(f"WITH {RATINGS}, {popular_sql('ratings')}, {GENRES}, {COLD_ITEM} SELECT * FROM cold")
def coldstart_new_item(spark, sf_dir):
    return coldstart.for_new_item(tables.items(spark, sf_dir), WANTED_GENRES, None, _all_popular(spark, sf_dir))


@query(f"WITH {RATINGS}, {popular_sql('ratings')}, {GENRES}, {COLD_USER}, {COLD_ITEM.replace('cold AS', 'cold2 AS')} SELECT (SELECT count(*) > 0 FROM cold) AS new_user_non_empty, (SELECT count(*) = 0 FROM cold WHERE title IN {LIKED}) AS new_user_excludes_liked_titles, (SELECT count(*) > 0 FROM (SELECT DISTINCT unnest(g) AS x FROM parsed) WHERE list_contains({WANTED_GENRES}, x)) AS new_item_vector_has_genres, (SELECT count(*) > 0 FROM cold2) AS new_item_non_empty")
def coldstart_validation(spark, sf_dir):
    return coldstart.validation(tables.items(spark, sf_dir), LIKED_TITLES, WANTED_GENRES, _all_popular(spark, sf_dir))


# --- registry, serving, titles, streaming ---------------------------------------------------------------------


@query()
def registry_roundtrip(spark, sf_dir):
    import uuid

    registry = ModelRegistry(spark, f"{folder(spark)}/registry-{uuid.uuid4().hex}")
    counts = popularity.counts(tables.ratings(spark, sf_dir))
    registry.register("popularity", {"counts": counts}, {"items": float(counts.count())})
    registry.register("popularity", {"counts": counts}, {"items": float(counts.count())}, {"again": True})
    loaded = registry.load("popularity")["counts"]
    return registry.registered().select("name", "version", F.col("metrics")["items"].alias("items")).join(loaded.agg(F.count("*").alias("rows"), F.sum("cnt").alias("total")))


SERVED = f"WITH {SPLIT}, {popular_sql('train')}, {popular_recs_sql('ratings')}, {ITEMS}"


def _served(spark, sf_dir):
    train, _, _ = _parts(spark, sf_dir)
    known = tables.ratings(spark, sf_dir)
    state = serve.ModelState(train, known, tables.items(spark, sf_dir), known.select("user_id").distinct())
    return serve.shaped(serve.METHODS["popularity"](state, K), state.items, K), known


@query(f"{SERVED} SELECT user_id, item_id, coalesce(title, 'Unknown Movie') AS title, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 4) AS score, rank FROM (SELECT *, min(score) OVER (PARTITION BY user_id) AS lo, max(score) OVER (PARTITION BY user_id) AS hi FROM poprecs) LEFT JOIN items USING (item_id)")
def serve_recommend(spark, sf_dir):
    return _served(spark, sf_dir)[0]


@query(f"{SERVED} SELECT count(*) AS known_items_served FROM poprecs JOIN ratings USING (user_id, item_id)")
def serve_excludes_history(spark, sf_dir):
    recs, known = _served(spark, sf_dir)
    return recs.join(known, ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("known_items_served"))


@query()
def method_comparison(spark, sf_dir):
    train, _, test = _parts(spark, sf_dir)
    state = serve.ModelState(train, train, tables.items(spark, sf_dir), _users(spark, sf_dir))
    return serve.compare(state, test, _catalogue(spark, sf_dir))


@query(f"""{CF}, {popular_recs_sql('train')}, {item_cf_sql(8)}, {filled_sql('cf', 'train')},
m AS (SELECT 'popularity' AS method, 0.5 AS ms, ndcg FROM (WITH {per_user_sql('poprecs', 'test')} SELECT round(avg(ndcg), 6) AS ndcg FROM per_user) UNION ALL SELECT 'item_cf', 12.0, ndcg FROM (WITH {per_user_sql('filled', 'test')} SELECT round(avg(ndcg), 6) AS ndcg FROM per_user))
SELECT method, CASE WHEN ms < 10 THEN 'best ndcg@10 under 10ms' ELSE 'best ndcg@10 overall' END AS rule FROM m ORDER BY (ms < 10) DESC, ndcg DESC, method LIMIT 1""")
def pick_winner(spark, sf_dir):
    train, _, test = _parts(spark, sf_dir)
    popular, users, n = popularity.counts(train), _users(spark, sf_dir), _catalogue(spark, sf_dir)
    one = ranking.evaluate(popularity.recommend(users, train, popular, K), test, n).select(F.lit("popularity").alias("method"), F.lit(0.5).alias("ms_per_req"), "ndcg")
    two = ranking.evaluate(recommend.item_cf_filled(train, _near(train), users, popular), test, n).select(F.lit("item_cf").alias("method"), F.lit(12.0).alias("ms_per_req"), "ndcg")
    return recommend.pick_winner(one.unionByName(two))


@query(f"{PER_USER}, {ITEMS} SELECT user_id, item_id, coalesce(title, 'Unknown Movie') AS title FROM poprecs LEFT JOIN items USING (item_id)")
def title_lookup(spark, sf_dir):
    return factor.with_titles(_popular_recs(spark, sf_dir)[0], tables.items(spark, sf_dir)).select("user_id", "item_id", "title")


@query(f"WITH {ITEMS} SELECT item_id, title, genres FROM items WHERE regexp_matches(title, '(?i)BOLT') ORDER BY item_id LIMIT 1")
def title_regex_match(spark, sf_dir):
    return factor.find_title(tables.items(spark, sf_dir), "BOLT").select("item_id", "title", "genres")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS item_id, count(*) AS cnt FROM events GROUP BY 1, 2")
def windowed_popularity(spark, sf_dir):
    rows = streaming.windowed(tables.table(spark, sf_dir, "events"))
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "item_id", "cnt")
