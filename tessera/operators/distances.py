"""Distances to a palette, stored: what only depends on pixels and clusters is computed once for all weights and softnesses.

A table is named by a digest of the pixels' version and the clusters, so other clusters or other pixels are another table,
and none is ever out of date. It holds px_id and d, read instead of the pixels; a second setting touches no colour.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from .palette import Cluster, effective_weight, with_distances


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_of(px: DataFrame) -> str:
    """A digest of how the pixels are made and of the files that they are made from: names, lengths and times."""
    parts = [str(px.semanticHash())]
    for f in sorted(px.inputFiles()):
        path, fs = _path(px.sparkSession, f)
        status = fs.getFileStatus(path)
        parts.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class DistanceStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def place(self, version: str, clusters: list[Cluster]) -> str:
        """The folder of a table; version is the pixels' (see version_of)."""
        digest = hashlib.sha256(json.dumps([version, [list(map(float, c)) for c in clusters]]).encode()).hexdigest()
        return f"{self.folder}/{digest}"

    def distances(self, px: DataFrame, clusters: list[Cluster], version: str | None = None) -> DataFrame:
        """px_id and d of all pixels, from the store, or put there first."""
        where = self.place(version or version_of(px), clusters)
        done, fs = _path(self.spark, f"{where}/_SUCCESS")
        if not fs.exists(done):
            with_distances(px, clusters).select("px_id", "d").write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where)

    def weights(self, px: DataFrame, clusters: list[Cluster], weights: list[float], softness: float = 0, version: str | None = None) -> DataFrame:
        """px_id and ew."""
        return self.distances(px, clusters, version).select("px_id", effective_weight(weights, softness).alias("ew"))

    def forget(self, keep: list[str]) -> int:
        """Deletes all tables but those at the given places; returns how many."""
        path, fs = _path(self.spark, self.folder)
        keep_names = {k.rstrip("/").rsplit("/", 1)[-1] for k in keep}
        found = [s for s in (fs.listStatus(path) if fs.exists(path) else []) if s.isDirectory() and s.getPath().getName() not in keep_names]
        return sum(bool(fs.delete(s.getPath(), True)) for s in found)
