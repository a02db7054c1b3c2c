"""Suggestions from genres alone, for new users and new items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import genres


def _ranked(items: DataFrame, wanted: Column, popular: DataFrame | None, n: int) -> DataFrame:
    rows = items.withColumn("_g", F.array_distinct(genres.parse(F.col("genres")))).withColumn("overlap", F.size(F.array_intersect("_g", wanted))).where("overlap > 0")
    rows = rows.withColumn("jaccard", F.col("overlap") / F.size(F.array_union(F.col("_g"), wanted)))
    rows = rows.join(popular, "item_id", "left") if popular is not None else rows.withColumn("cnt", F.lit(0))
    rows = rows.withColumn("popularity", F.coalesce("cnt", F.lit(0)).cast("long"))
    order = (F.desc("overlap"), F.desc("jaccard"), F.desc("popularity"), "title", "item_id")
    return rows.orderBy(*order).limit(n).select("item_id", "title", F.col("overlap").cast("long").alias("overlap"), F.round("jaccard", 6).alias("jaccard"), "popularity")


def for_new_user(items: DataFrame, liked_titles: list[str], popular: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Items that share genres with the liked titles: most overlap, then Jaccard, popularity, title.

    Liked titles are excluded by title; items without genres are passed over; unknown titles give nothing.
    The liked genres are one row, gathered from the items of those titles.
    """
    liked = items.where(F.col("title").isin(*liked_titles)) if liked_titles else items.limit(0)
    wanted = liked.select(F.explode(genres.parse(F.col("genres"))).alias("g")).agg(F.array_sort(F.collect_set("g")).alias("_wanted"))
    others = items.where(~F.col("title").isin(*liked_titles)) if liked_titles else items
    return _ranked(others.join(F.broadcast(wanted)), F.col("_wanted"), popular, n)


def for_new_item(items: DataFrame, genre_list: list[str], title: str | None = None, popular: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Items that share genres with the list, in the same order; items of the same title are excluded."""
    others = items if title is None else items.where(F.col("title") != title)
    wanted = F.array_distinct(F.array(*(F.lit(g) for g in genre_list))) if genre_list else F.array().cast("array<string>")
    return _ranked(others, wanted, popular, n)


def validation(items: DataFrame, liked_titles: list[str], genre_list: list[str], popular: DataFrame | None = None) -> DataFrame:
    """One row of four flags: both lists are non-empty, liked titles are excluded, the genres are known."""
    user, item = for_new_user(items, liked_titles, popular), for_new_item(items, genre_list, None, popular)
    one = user.agg((F.count("*") > 0).alias("new_user_non_empty"), (F.count_if(F.col("title").isin(*liked_titles)) == 0).alias("new_user_excludes_liked_titles"))
    two = genres.encode(genre_list, genres.vocabulary(items)).agg((F.coalesce(F.sum("value"), F.lit(0)) > 0).alias("new_item_vector_has_genres"))
    return one.join(two).join(item.agg((F.count("*") > 0).alias("new_item_non_empty")))
