"""Top-n, masking and ranking metrics over (user_id, item_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written


def numbered(rows: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """rows with their place from 0 in the whole order, which must be total: no task sorts or sees all of them.

    Rows are range-partitioned, sorted and written once with their place in their partition; places then only need
    the sizes of the partitions before, one row each.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.expr("coalesce(sum(_size) over (order by _part rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def top_n(scored: DataFrame, n: int, by: str | list[str] = "user_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The n best rows of each ``by``, ranked from 1: score falling, then item rising."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def unseen(scored: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (user_id, item_id) is not in seen."""
    return scored.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def normalised(scored: DataFrame, by: str = "user_id", score: str = "score") -> DataFrame:
    """score moved to 0..1 within each ``by``; 1 where all are equal."""
    whole = Window.partitionBy(by)
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    return scored.withColumn(score, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def _ideal(k: int, truth: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), truth).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))


def per_user(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, precision, recall, ndcg) of every user with a truth; users without recommendations get 0."""
    size = truth.groupBy("user_id").agg(F.count("*").alias("_truth"))
    hits = recs.where(F.col("rank") <= k).join(truth.select("user_id", "item_id"), ["user_id", "item_id"])
    hits = hits.groupBy("user_id").agg(F.count("*").alias("_hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("_gain"))
    rows = size.join(hits, "user_id", "left").na.fill(0, ["_hits"]).na.fill(0.0, ["_gain"])
    if k <= 0:
        return rows.select("user_id", *(F.lit(0.0).alias(c) for c in ("precision", "recall", "ndcg")))
    return rows.select("user_id", (F.col("_hits") / F.lit(float(k))).alias("precision"), (F.col("_hits") / F.col("_truth")).alias("recall"), (F.col("_gain") / _ideal(k, F.col("_truth"))).alias("ndcg"))


def evaluate(recs: DataFrame, truth: DataFrame, catalogue: int, k: int = 10) -> DataFrame:
    """One row: k, users, mean precision, recall and ndcg over users with a truth, and coverage: the share of the
    catalogue that is recommended to anyone."""
    scores = per_user(recs, truth, k).agg(F.count("*").alias("users"), *(F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c) for c in ("precision", "recall", "ndcg")))
    covered = recs.where(F.col("rank") <= k).agg(F.countDistinct("item_id").alias("_covered"))
    coverage = F.round(F.col("_covered") / F.lit(float(catalogue)), 6) if catalogue else F.lit(0.0)
    return scores.join(covered).select(F.lit(k).cast("long").alias("k"), "users", "precision", "recall", "ndcg", coverage.alias("coverage"))


def sweep_ks(recs: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, users, precision, recall, ndcg) for each k of one ranking, in one pass over its hits."""
    size = truth.groupBy("user_id").agg(F.count("*").alias("_truth"))
    hits = recs.where(F.col("rank") <= max(ks)).join(truth.select("user_id", "item_id"), ["user_id", "item_id"]).groupBy("user_id").agg(F.collect_list("rank").alias("_ranks"))
    rows = size.join(hits, "user_id", "left").withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))))
    own = F.filter(F.coalesce("_ranks", F.array().cast("array<bigint>")), lambda r: r <= F.col("k"))
    gain = F.aggregate(own, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("k", "_truth")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    rows = rows.select("k", (F.size(own) / F.col("k")).alias("precision"), (F.size(own) / F.col("_truth")).alias("recall"), (gain / ideal).alias("ndcg"))
    return rows.groupBy("k").agg(F.count("*").alias("users"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "ndcg")))


def best(rows: DataFrame, *by: str) -> DataFrame:
    """The row with the largest ``by``, in that order; ties go to the least of the first column."""
    return rows.orderBy(*(F.desc(c) for c in by), rows.columns[0]).limit(1)
