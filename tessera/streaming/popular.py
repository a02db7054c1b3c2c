"""Popularity of items over a stream of events, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, item_id, cnt) of events; later than ``late`` they no longer count in a stream."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("item_id"))
    rows = rows.withWatermark("ts", late).groupBy(F.window("ts", window), "item_id").agg(F.count("*").alias("cnt"))
    return rows.select(F.col("window.start").alias("window_start"), "item_id", "cnt")


def stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)
