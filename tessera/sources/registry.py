"""A versioned registry of model tables.

A version is a folder of Parquet tables and a manifest of one JSON line, written last: a version without a
manifest does not count.  Nothing is overwritten.  All access is through Spark, so the root may lie in any store.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, version long, registered_at string, tables array<string>, metrics map<string,double>, params map<string,string>"


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def registered(self) -> DataFrame:
        """(name, version, registered_at, tables, metrics, params) of every version; empty without a registry."""
        if not self._exists(f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(f"{self.root}/manifest")
        return rows.where("name is not null and version is not null")

    def latest(self, name: str) -> dict | None:
        row = self.registered().where(F.col("name") == name).orderBy(F.desc("version")).first()
        return row.asDict(recursive=True) if row else None

    def register(self, name: str, tables: dict[str, DataFrame], metrics: dict[str, float] | None = None, params: dict[str, object] | None = None) -> int:
        """Write a new version of ``name`` and return its number."""
        last = self.latest(name)
        version = (last["version"] if last else 0) + 1
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/models/{name}/v={version}/{table}")
        entry = {
            "name": name, "version": version, "registered_at": datetime.now(timezone.utc).isoformat(), "tables": sorted(tables),
            "metrics": {k: float(v) for k, v in (metrics or {}).items()}, "params": {k: str(v) for k, v in (params or {}).items()},
        }
        self.spark.range(1).select(F.lit(json.dumps(entry)).alias("value")).write.mode("append").text(f"{self.root}/manifest")
        return version

    def load(self, name: str, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the latest by default; ValueError for an unknown name or version."""
        rows = self.registered().where(F.col("name") == name)
        entry = (rows.where(F.col("version") == version) if version else rows).orderBy(F.desc("version")).first()
        if entry is None:
            raise ValueError(f"no model {name!r}" + (f" of version {version}" if version else ""))
        return {t: self.spark.read.parquet(f"{self.root}/models/{name}/v={entry['version']}/{t}") for t in entry["tables"]}
