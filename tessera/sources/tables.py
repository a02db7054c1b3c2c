"""Sources: delimited and Parquet interaction files, the stored split, and adapters over the driver's tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators.split import three_way


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Interactions from a headed CSV file (userId, movieId, rating, timestamp) or a Parquet table of those."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema.RATINGS_CSV).option("header", True).option("escape", '"').csv(path)
    stamp = F.timestamp_seconds("timestamp").cast("timestamp_ntz")
    return rows.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), F.round(F.col("rating") * 2).cast("long").alias("r2"), "rating", stamp.alias("ts"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items from a headed CSV file (movieId, title, genres) or a Parquet table of those."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema.ITEMS_CSV).option("header", True).option("escape", '"').csv(path)
    return rows.select(F.col("movieId").alias("item_id"), "title", "genres")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' purchases as interactions: (user_id, item_id, r2 in half stars 1 to 10, rating, ts)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
    rows = rows.agg(F.max(F.ceil(F.col("l_quantity") / 5)).cast("long").alias("r2"), F.max("o_orderdate").alias("ts"))
    return rows.select("user_id", "item_id", "r2", (F.col("r2") / F.lit(2.0)).alias("rating"), "ts")


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions: (user_id, item_id, value, ts)."""
    key = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id", key.alias("item_id")).agg(F.max("value").alias("value"), F.max("ts").alias("ts"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items; the genres are the words of the name and the type, parted by |."""
    genres = F.concat_ws("|", F.split("p_name", " "), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), genres.alias("genres"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, token): the distinct lower-case words of each document."""
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.explode(words).alias("token")).where("token <> ''")


def doc_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, token): the lower-case words of each document that has any, as an array; some more than once."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), words.alias("token")).where(F.size("token") > 0)


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, vector, label) of the embeddings, in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def stored_split(interactions: DataFrame, path: str, validation: float = 0.2, test: float = 0.2) -> DataFrame:
    """The three-way split, read from ``path`` if it was made from the same rows and ratios, else made and written.

    The folder's name holds a fingerprint of the rows (an order-free hash sum) and the ratios.  Files are parted
    by split, so reading one split reads only its files.
    """
    spark = interactions.sparkSession
    n, total = interactions.select(F.count("*"), F.sum(F.xxhash64(*interactions.columns).cast("decimal(38,0)"))).first()
    folder = f"{path.rstrip('/')}/{hashlib.sha256(f'{n}|{total}|{validation}|{test}'.encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        three_way(interactions, validation, test).write.mode("overwrite").partitionBy("split").parquet(folder)
    return spark.read.parquet(folder)
