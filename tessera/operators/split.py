"""Temporal splits per user.  Ties in time are ordered by item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _placed(interactions: DataFrame) -> DataFrame:
    """With each row's place in its user's history and the history's length; one shuffle on user."""
    user = Window.partitionBy("user_id")
    return interactions.withColumn("_at", F.row_number().over(user.orderBy("ts", "item_id"))).withColumn("_n", F.count("*").over(user))


def _share(n, ratio: float):
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio))))


def two_way(interactions: DataFrame, test: float = 0.2) -> DataFrame:
    """With split: the last max(1, n * test) rows of a user are test; a single row is train."""
    size = F.when(F.col("_n") > 1, _share(F.col("_n"), test)).otherwise(0)
    return _placed(interactions).withColumn("split", F.when(F.col("_at") > F.col("_n") - size, "test").otherwise("train")).drop("_at", "_n")


def three_way(interactions: DataFrame, validation: float = 0.2, test: float = 0.2) -> DataFrame:
    """With split: train, then val, then test.  Users of fewer than three rows are train only.

    Validation shrinks, to one row at least, where both parts would leave no training row.
    """
    n, last = F.col("_n"), _share(F.col("_n"), test)
    wished = _share(n, validation)
    middle = F.when(last + wished >= n, F.greatest(F.lit(1), n - last - 1)).otherwise(wished)
    split = F.when(n < 3, "train").when(F.col("_at") > n - last, "test").when(F.col("_at") > n - last - middle, "val").otherwise("train")
    return _placed(interactions).withColumn("split", split).drop("_at", "_n")


def leaks(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Users whose last earlier row is after their first later one; empty if the split is sound."""
    last, first = earlier.groupBy("user_id").agg(F.max("ts").alias("last")), later.groupBy("user_id").agg(F.min("ts").alias("first"))
    return last.join(first, "user_id").where("last > first")


def verify(earlier: DataFrame, later: DataFrame, label: str = "validation/test") -> None:
    """Raise ValueError naming a user whose split leaks."""
    found = leaks(earlier, later).orderBy("user_id").first()
    if found is not None:
        raise ValueError(f"user {found['user_id']} has training rows after the start of {label}")
