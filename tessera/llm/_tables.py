"""Connected components of binary-named nodes, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import dropped, shuffles_removed, written

__all__ = ["components", "dropped", "shuffles_removed", "small_batches", "spread", "written"]

#: Bytes of an Arrow batch between the executor and its Python workers, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of documents by bytes, not by rows alone: a worker's memory then does not follow the texts' length."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of one key that a join puts into one task, and most keys that may have more.
ROWS_OF_A_KEY, KEYS_BROADCAST = 1000, 20_000


def spread(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with table (one row a key, ``count`` of rows with it, ``total`` at most in all) on ``key``.

    A key with many rows is dealt over several tasks by a salt, so that none holds them all; which keys those are is
    broadcast, at most KEYS_BROADCAST of them.
    """
    most = max(ROWS_OF_A_KEY, -(-total // KEYS_BROADCAST))
    parts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    heavy = table.where(F.col(count) > most).select(key, parts.alias("_parts"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return marked.withColumn("_salt", salt).drop("_parts").join(dealt, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of the undirected graph with edges (a, b); root is the least node of the component.

    Alternating large-star and small-star contraction (Kiveris et al., 2014).  Each round is written to the
    shared folder, and hubs are dealt over several tasks.  Nothing but a count and a checksum reaches the driver.
    Raises if it does not converge.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = lambda t: t.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(e)
    for _ in range(60):
        if not before[0]:
            break
        total = 2 * before[0]
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_c"))
        large = spread(both, low, "a", "_c", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_c"))
        joined = spread(large, low, "a", "_c", total)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), name)
        dropped(large)
        dropped(e)
        e, after = new, mark(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge in 60 rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
