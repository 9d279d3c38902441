"""Fits over a growing input: the histogram is the state of a streaming aggregation, and curves are renewed with every micro-batch.

Pixels come with a sign, 1 for new ones and -1 for ones that are gone. Counts are sums of signs, so they do not depend on how
pixels are dealt to micro-batches, and the state is 256 numbers a channel, however many pixels there were. Each micro-batch writes
the curves of all so far as a version of its own, named by its number; a repeated one writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dist import OPAQUE, axis, cdf, histogram, specify
from tessera.sources.shared import materialize


def running_histogram(px: DataFrame, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """ch, v, n of a stream of pixels with a column sign."""
    rows = px.filter(F.col("a") >= OPAQUE).select("sign", F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).cast("int").alias("v")) for c in names])).alias("x"))
    return rows.groupBy("x.ch", "x.v").agg(F.sum("sign").cast("long").alias("n"))


def dense(hist: DataFrame, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    every = axis(hist).select(F.explode(F.array(*map(F.lit, names))).alias("ch"), "v")
    return every.join(hist, ["ch", "v"], "left").select("ch", "v", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fit_stream(source: DataFrame, target: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that fits the stream target (r, g, b, a, sign) to the table source, over all there is, and writes curves under the folder."""
    wanted = materialize(cdf(histogram(source)), "source-cdf")

    def renew(hist: DataFrame, batch: int) -> None:
        """One file by a shuffle of the curves: to coalesce would run all partitions' windows and joins in one task, which holds their memory until it ends."""
        specify(wanted, cdf(dense(hist))).repartition(1).write.mode("overwrite").parquet(f"{folder}/version={batch}")

    writer = running_histogram(target).writeStream.outputMode("complete").foreachBatch(renew)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_fit(spark: SparkSession, folder: str) -> DataFrame:
    """ch, v, out of the last version."""
    versions = spark.read.parquet(folder)
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == last).drop("version")
