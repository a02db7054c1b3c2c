"""Item-item cosine, exact Jaccard and nearest lists, by a self-join on what items share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranking, tiles
from tessera.sources.shared import dropped, written

#: Similarities are summed as whole billionths, so that sums do not depend on their order.
SCALE = 1_000_000_000


#: Rows of one key that a self-join puts into one task on its left side.
ROWS_OF_A_KEY = 2000


def dealt(rows: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(left, right) of a self-join on ``key`` and _salt: a key of many rows is dealt over several tasks on the left, and
    copied to each of them on the right, so that every pair meets once and no task holds all of a key's pairs."""
    parts = F.ceil(F.count("*").over(Window.partitionBy(*key)) / F.lit(ROWS_OF_A_KEY)).cast("int")
    counted = rows.withColumn("_parts", parts)
    left = counted.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"))
    right = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return left.drop("_parts"), right.drop("_parts")


def norms(interactions: DataFrame) -> DataFrame:
    """(item_id, norm2): the sum of squared half-star ratings, a whole number."""
    return interactions.groupBy("item_id").agg(F.sum(F.col("r2") * F.col("r2")).alias("norm2"))


def cosine_pairs(interactions: DataFrame) -> DataFrame:
    """(a, b, dot, sim) for a < b that some user rated both.

    Cosine does not change with the scale, so half stars are multiplied as whole numbers and divided once.
    Pairs are finished within tiles of two blocks of items and never shuffled.
    """
    return tiles.products(interactions.select("user_id", "item_id", "r2"), "cosine").withColumnRenamed("both", "dot")


def nearest_cosine(interactions: DataFrame, k: int = 20) -> DataFrame:
    """nearest of cosine_pairs; only each tile's k nearest of an item leave the tile."""
    return _ranked(tiles.products(interactions.select("user_id", "item_id", "r2"), "cosine", k), k)


def mirrored(pairs: DataFrame, *extra: str) -> DataFrame:
    """Both directions of pairs (a, b, sim)."""
    return pairs.select("a", "b", "sim", *extra).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", *extra))


def nearest(pairs: DataFrame, k: int = 20) -> DataFrame:
    """(a, b, sim, simq, rank): the k most similar b of each a; simq is sim in whole billionths, ties to the least b."""
    return _ranked(mirrored(pairs).withColumn("simq", F.round(F.col("sim") * SCALE).cast("long")), k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("simq"), "b")).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _cells(sets: DataFrame, item: str, token: str) -> DataFrame:
    return sets.select(F.col(token).alias("token"), F.col(item).alias("item")).distinct().withColumn("one", F.lit(1))


def jaccard_pairs(sets: DataFrame, item: str = "item_id", token: str = "token") -> DataFrame:
    """(a, b, shared, sim) for a < b with a token in common; counts are long and cannot wrap."""
    return tiles.products(_cells(sets, item, token), "jaccard").withColumnRenamed("both", "shared")


def nearest_jaccard(sets: DataFrame, k: int = 20, item: str = "item_id", token: str = "token") -> DataFrame:
    """nearest of jaccard_pairs; only each tile's k nearest of an item leave the tile."""
    return _ranked(tiles.products(_cells(sets, item, token), "jaccard", k), k)


def jaccard_nested(sets: DataFrame, item: str = "item_id", token: str = "token") -> DataFrame:
    """(a, b, sim) of every pair a < b by comparing whole sets: the slow form that others are held against."""
    rows = sets.groupBy(F.col(item).alias("a")).agg(F.collect_set(token).alias("sa"))
    other = rows.select(F.col("a").alias("b"), F.col("sa").alias("sb"))
    return rows.join(other, F.col("a") < F.col("b")).select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("sim"))


def jaccard_at_least(sets: DataFrame, threshold: float, item: str = "item_id", token: str = "token", expand: bool = True) -> DataFrame:
    """(a, b, shared, sim) for a < b with a similarity of ``threshold`` or more, by prefix filtering.

    In the order of rising frequency, two sets that reach the threshold share one of their first
    n - ceil(threshold n) + 1 tokens, so frequent tokens are hardly ever counted.  How many of those they share is
    counted in tiles, and a pair leaves its tile only if its sizes fit, that count and the places left reach the
    overlap that the threshold asks for, and parities of all tokens do not differ too often.
    Equal sets are taken as one; their rows are multiplied at the end.  Without ``expand`` they are not: pairs then
    are those of the least items of equal sets, and each item with the least one of its set, which links the same
    items.  Pairs are verified by whole sets.  ``token`` is a token a row or an array of them; tokens are compared by
    64 bits of hash.
    """
    named = tiles.hashed_sets(sets, item, token)
    kinds = tiles.kinds_of_sets(named, threshold)
    members = written(named.select("h", "item"), "members")
    pairs = written(tiles.verified_sets(tiles.prefix_pairs(kinds, threshold), named), "pairs")
    dropped(named)
    pairs = pairs.withColumn("sim", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("sim") >= threshold)
    ids = kinds.select("y", "x", "h", "n")
    for k in "ab":
        pairs = pairs.join(ids.select(F.col("y").alias(k), F.col("x").alias(f"x{k}"), F.col("h").alias(f"h{k}")), k)
    pairs = pairs.select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b"), "shared", "sim", "ha", "hb")
    size = ids.select(F.col("h").alias("ha"), F.col("n").alias("shared"), F.col("x").alias("a"))
    if not expand:
        copies = members.withColumnRenamed("h", "ha").join(size, "ha").where(F.col("item") > F.col("a"))
        return pairs.select("a", "b", "shared", "sim").unionByName(copies.select("a", F.col("item").alias("b"), "shared", F.lit(1.0).alias("sim")))
    pairs = pairs.drop("a", "b")
    first, second = members.select(F.col("h").alias("ha"), F.col("item").alias("i")), members.select(F.col("h").alias("hb"), F.col("item").alias("j"))
    apart = pairs.join(first, "ha").join(second, "hb").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "shared", "sim")
    twins = first.join(second, F.col("ha") == F.col("hb")).where("i < j").join(size.drop("a"), "ha")
    return apart.unionByName(twins.select(F.col("i").alias("a"), F.col("j").alias("b"), "shared", F.lit(1.0).alias("sim")))
