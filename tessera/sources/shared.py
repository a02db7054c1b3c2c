"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset one temporary folder of the session, in local runs only.

    On a cluster a folder of one machine would scatter the tables, so an unset spark.checkpoint.dir is an error there.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not place and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.shared.dir", place)
    return place.rstrip("/")


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


#: Spark removes a plan's shuffle files as soon as the plan has run; by itself it waits for the driver to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind.  For plans that are run once: another run makes them anew."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: its lineage ends there, and losing executors loses nothing.

    The shuffle files of its plan go at once.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _path(spark, path)
    files.deleteOnExit(place)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    place, files = _path(df.sparkSession, df._tessera_path)
    files.delete(place, True)
