"""Id maps, incidence matrices in coordinate form, item sets and lists, catalogue statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ranking


def id_map(*columns: DataFrame) -> DataFrame:
    """(id, idx): the distinct ids of the one-column frames, numbered from 0 in rising order.

    Ids are range-partitioned and counted by partition, so no task sees all of them.
    """
    ids = columns[0].toDF("id")
    for other in columns[1:]:
        ids = ids.unionByName(other.toDF("id"))
    ids = ids.where("id is not null").distinct()
    return ranking.numbered(ids, "id").select("id", "idx")


def matrix(interactions: DataFrame, binary: bool = False) -> DataFrame:
    """(user_id, item_id, value): the ratings, or 1; repeated pairs add up."""
    value = F.lit(1.0) if binary else F.col("rating")
    return interactions.groupBy("user_id", "item_id").agg(F.sum(value).alias("value"))


def item_sets(interactions: DataFrame) -> DataFrame:
    """(user_id, item_id) once each."""
    return interactions.select("user_id", "item_id").distinct()


def rating_lists(interactions: DataFrame) -> DataFrame:
    """(user_id, ratings): each user's (item_id, rating) in the order of item."""
    return interactions.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "rating"))).alias("ratings"))


def adjacency_differs(interactions: DataFrame) -> DataFrame:
    """Pairs that the matrix and the lists do not share; empty if both say the same."""
    pairs = matrix(interactions, binary=True).select("user_id", "item_id")
    listed = rating_lists(interactions).select("user_id", F.explode("ratings.item_id").alias("item_id")).distinct()
    return pairs.exceptAll(listed).unionAll(listed.exceptAll(pairs))


def statistics(interactions: DataFrame) -> DataFrame:
    """One row: users, items, interactions, sparsity, the busiest user and the most rated item with their counts."""
    by_user = interactions.groupBy("user_id").agg(F.count("*").alias("n"))
    by_item = interactions.groupBy("item_id").agg(F.count("*").alias("n"))
    most = lambda key: F.max_by(key, F.struct("n", -F.col(key)))  # noqa: E731  ties: the least id
    users = by_user.agg(F.count("*").alias("users"), F.sum("n").alias("interactions"), most("user_id").alias("busiest_user"), F.max("n").alias("busiest_user_count"))
    things = by_item.agg(F.count("*").alias("items"), most("item_id").alias("top_item"), F.max("n").alias("top_item_count"))
    sparsity = 1 - F.col("interactions") / (F.col("users").cast("double") * F.col("items"))
    return users.join(things).select("users", "items", "interactions", F.round(sparsity, 9).alias("sparsity"), "busiest_user", "busiest_user_count", "top_item", "top_item_count")


def csr_memory_mb(rows: int, entries: int, value_bytes: int = 8, index_bytes: int = 4) -> float:
    """What a compressed sparse row matrix of this size takes up."""
    return (entries * (value_bytes + index_bytes) + (rows + 1) * index_bytes) / 2**20
