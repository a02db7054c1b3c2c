"""Popularity counts and ranks, recommendations of the most popular, and the fallback to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.sources.shared import written


def counts(interactions: DataFrame) -> DataFrame:
    """(item_id, cnt)."""
    return interactions.groupBy("item_id").agg(F.count("*").alias("cnt"))


def top(popular: DataFrame, n: int) -> DataFrame:
    """(item_id, cnt, pop_rank) of the n most popular, ties to the least id: a bounded heap in each task."""
    best = popular.orderBy(F.desc("cnt"), "item_id").limit(n)
    return best.withColumn("pop_rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "item_id")).cast("long"))


def ranks(popular: DataFrame) -> DataFrame:
    """(item_id, cnt, pop_rank) of every item.

    Ranks are places in a range-partitioned order, so no task sorts the catalogue nor all items of one count.
    """
    return ranking.numbered(popular.select("item_id", "cnt"), F.desc("cnt"), F.col("item_id")).select("item_id", "cnt", (F.col("idx") + 1).alias("pop_rank"))


def unseen_popular(users: DataFrame, seen: DataFrame, popular: DataFrame) -> DataFrame:
    """(user_id, item_id, cnt, pop_rank): the ``need`` most popular items that a user has not seen.

    ``users`` has (user_id, need).  A user with s seen items finds them among the need + s most popular, so each
    asks for that many ranks and no more: the work follows the interactions, and nothing is crossed.
    """
    load = seen.groupBy("user_id").agg(F.count("*").alias("_s"))
    asked = users.join(load, "user_id", "left").withColumn("_k", (F.col("need") + F.coalesce("_s", F.lit(0))).cast("long"))
    best = ranks(popular)
    slots = asked.where("need > 0").select("user_id", "need", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))).alias("pop_rank"))
    open_slots = slots.join(best, "pop_rank").join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("pop_rank"))
    return open_slots.withColumn("_nth", nth).where("_nth <= need").select("user_id", "item_id", "cnt", "pop_rank")


def recommend(users: DataFrame, seen: DataFrame, popular: DataFrame, n: int = 10) -> DataFrame:
    """The n most popular unseen items of each user; the score is the count."""
    rows = unseen_popular(users.select("user_id").withColumn("need", F.lit(n)), seen, popular)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("pop_rank")).cast("long")
    return rows.select("user_id", "item_id", F.col("cnt").cast("double").alias("score"), rank.alias("rank"))


def fill(recs: DataFrame, users: DataFrame, seen: DataFrame, popular: DataFrame, n: int = 10) -> DataFrame:
    """recs, filled up to n rows a user with popular items of score 0 that are neither seen nor there yet."""
    recs = written(recs, "recs")  # read several times below
    have = recs.groupBy("user_id").agg(F.count("*").alias("_have"))
    short = users.select("user_id").join(have, "user_id", "left").select("user_id", (F.lit(n) - F.coalesce("_have", F.lit(0))).alias("need")).where("need > 0")
    taken = seen.select("user_id", "item_id").unionByName(recs.select("user_id", "item_id")).join(short, "user_id", "left_semi").distinct()
    more = unseen_popular(short, taken, popular)
    after = F.row_number().over(Window.partitionBy("user_id").orderBy("pop_rank"))
    more = more.withColumn("_after", after).join(have, "user_id", "left")
    more = more.select("user_id", "item_id", F.lit(0.0).alias("score"), (F.coalesce("_have", F.lit(0)) + F.col("_after")).cast("long").alias("rank"))
    return recs.select("user_id", "item_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank")).unionByName(more)
