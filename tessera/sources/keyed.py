"""A table of rows with distinct keys that is updated in place: only the buckets that hold a changed row are written.

Rows lie in folders by hash of their key. An update finds the buckets of the keys that it meets, reads those alone, and overwrites
them by dynamic partition overwrite: files are made beside the table and put into place at the commit, folder by folder, and the files
of all other buckets stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    placed = df.select("*", bucket_of(key, buckets))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert(spark: SparkSession, path: str, updates: DataFrame, key: str, buckets: int = BUCKETS, insert: bool = False) -> int:
    """Puts the updates' columns into the stored rows of the same key; returns how many buckets were written.

    Keys that are not stored are left out, or with insert added, with nulls for what the updates lack. Two updates of one key are an error."""
    stored = spark.read.parquet(path)
    names = [c for c in stored.columns if c != "bucket"]
    new = [c for c in updates.columns if c != key]
    if missing := [c for c in updates.columns if c not in names]:
        raise ValueError(f"the table has no {', '.join(missing)}")
    placed = updates.select("*", bucket_of(key, buckets))
    if not placed.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"updates repeat a {key}")
    met = placed if insert else placed.join(stored.select(key, "bucket"), [key, "bucket"], "left_semi")
    touched = sorted(r["bucket"] for r in met.select("bucket").distinct().collect())  # at most as many as there are buckets
    if not touched:
        return 0
    packed = placed.filter(F.col("bucket").isin(touched)).select(key, "bucket", F.struct(*[F.col(c).alias(c) for c in new], F.lit(True).alias("_here")).alias("_new"))
    whole = stored.filter(F.col("bucket").isin(touched)).join(packed, [key, "bucket"], "full" if insert else "left")
    kinds = dict(stored.dtypes)
    columns = [F.when(F.col("_new._here"), F.col("_new")[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in names]
    made = whole.select(*columns, "bucket").repartition("bucket")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)
