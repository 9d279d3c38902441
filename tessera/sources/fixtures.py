"""Pixel relations derived from the star-schema tables, and the small relations that queries take as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.color import half_up, num


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, g, b, a without an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_quantity") * num(5)).cast("int").alias("r"),
        F.floor(F.col("l_extendedprice") / num(412)).cast("int").alias("g"),
        (half_up(F.col("l_discount") * num(100)) * 25).alias("b"),
        F.when(F.col("l_returnflag") == "R", 64).when(F.col("l_returnflag") == "A", 128).otherwise(255).alias("a"),
    )


def target_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px_id, x, y, r, g, b, a of an image 100 pixels wide."""
    px = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        px.alias("px_id"),
        (px % 100).cast("int").alias("x"),
        F.floor(px / 100).cast("int").alias("y"),
        F.least(F.lit(255), F.floor("value").cast("int")).alias("r"),
        (F.col("user_id") * 37 % 256).cast("int").alias("g"),
        (F.hour("ts") * 10 + F.floor(F.minute("ts") / 6).cast("int")).alias("b"),
        F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 127).when(F.col("event_type") == "view", 128).otherwise(255).alias("a"),
    )


#: Lab and weight of three clusters, with weights above and below 1.
CLUSTERS = [(0, 20.0, 10.0, -30.0, 1.0), (1, 55.0, 60.0, 40.0, 0.5), (2, 80.0, -40.0, 50.0, 1.75)]


def clusters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLUSTERS, "k int, l double, a double, b double, w double")
