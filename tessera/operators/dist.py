"""Histograms, cumulative distributions and the fits that make one relation's channels match another's.

The pixel relations are read once each and partially aggregated to at most 768 rows; everything after that is of constant size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.color import byte, half_up, luma, num, with_lab, with_rgb

OPAQUE, VISIBLE = 128, 8
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def axis(px: DataFrame) -> DataFrame:
    return px.sparkSession.range(256).select(F.col("id").cast("int").alias("v"))


def channels(px: DataFrame, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """ch, v: one row per channel of each pixel."""
    return px.select(F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).cast("int").alias("v")) for c in names])).alias("x")).select("x.ch", "x.v")


def histogram(px: DataFrame, names: tuple[str, ...] = ("r", "g", "b"), least_alpha: int = OPAQUE) -> DataFrame:
    """ch, v, n for all 256 values."""
    counts = channels(px.filter(F.col("a") >= least_alpha), names).groupBy("ch", "v").count()
    dense = axis(px).select(F.explode(F.array(*map(F.lit, names))).alias("ch"), "v")
    return dense.join(counts, ["ch", "v"], "left").select("ch", "v", F.coalesce("count", F.lit(0)).alias("n"))


def cdf(hist: DataFrame) -> DataFrame:
    """hist with cum, tot and c in [0, 1]; all 0 where there are no pixels."""
    by = W.partitionBy("ch")
    df = hist.withColumns({"cum": F.sum("n").over(by.orderBy("v").rowsBetween(W.unboundedPreceding, 0)), "tot": F.sum("n").over(by)})
    return df.withColumn("c", F.when(F.col("tot") == 0, num(0)).otherwise(F.col("cum") / F.col("tot")))


def specify(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Curves ch, v, out: the least source value whose share reaches that of v. Two cdfs of 768 rows meet."""
    s = src.select("ch", F.col("v").alias("u"), F.col("c").alias("sc"))
    hit = tgt.select("ch", "v", "c").join(s, (tgt["ch"] == s["ch"]) & (s["sc"] >= tgt["c"]), "left")
    return hit.groupBy(tgt["ch"], tgt["v"]).agg(F.coalesce(F.min("u"), F.lit(255)).alias("out"))


def fit_full(src: DataFrame, tgt: DataFrame) -> DataFrame:
    return specify(cdf(histogram(src)), cdf(histogram(tgt)))


def percentile(cdfs: DataFrame, p: float) -> Column:
    """Aggregate: the least value that reaches the share p; 128 for no pixels, 255 if none does."""
    return F.when(F.max("tot") == 0, 128).otherwise(F.coalesce(F.min(F.when(F.col("cum") >= F.col("tot") * num(p), F.col("v"))), F.lit(255)))


def percentiles(px: DataFrame, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """ch and an array of the values at ps."""
    c = cdf(histogram(px))
    return c.groupBy("ch").agg(F.array(*[percentile(c, p) for p in ps]).alias("q"))


def _shift(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """ch and the difference of m, as curves; none where either side is missing."""
    d = src.select("ch", F.col("m").alias("ms")).join(tgt.select("ch", F.col("m").alias("mt")), "ch")
    d = d.select("ch", F.coalesce(F.col("ms") - F.col("mt"), num(0)).alias("d"))
    return axis(src).crossJoin(F.broadcast(d)).select("ch", "v", byte(F.col("v") + F.col("d")).alias("out"))


def fit_mean(src: DataFrame, tgt: DataFrame) -> DataFrame:
    def mean(px: DataFrame) -> DataFrame:
        h = histogram(px)
        return h.groupBy("ch").agg((F.sum(F.col("v") * F.col("n")).cast("double") / F.when(F.sum("n") > 0, F.sum("n"))).alias("m"))

    return _shift(mean(src), mean(tgt))


def fit_median(src: DataFrame, tgt: DataFrame) -> DataFrame:
    half = lambda px: percentiles(px, (0.5,)).select("ch", F.element_at("q", 1).cast("double").alias("m"))
    return _shift(half(src), half(tgt))


def fit_percentiles(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Piecewise linear through the percentiles of both, with fixed ends."""
    s, t = percentiles(src), percentiles(tgt)
    ends = s.select("ch", F.concat(F.array(F.lit(0)), "q", F.array(F.lit(255))).alias("ys")).join(t.select("ch", F.concat(F.array(F.lit(0)), "q", F.array(F.lit(255))).alias("xs")), "ch")
    df = axis(src).crossJoin(F.broadcast(ends))
    n = len(PERCENTILES)
    i = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda k: F.col("v") <= F.element_at("xs", k + 1))), F.lit(n + 1))
    xa, xb, ya, yb = (F.element_at(c, i + k) for c in ("xs", "ys") for k in (0, 1))
    span = F.when(xb == xa, 1).otherwise(xb - xa)
    return df.select("ch", "v", byte(ya + (yb - ya) * ((F.col("v") - xa) / span)).alias("out"))


def lab_bins(px: DataFrame) -> DataFrame:
    """Pixels with the bins of their Lab values as r, g, b: L, a and b in bytes."""
    df = with_lab(px)
    return df.withColumns({"lb": byte(F.col("lab_l") * num(2.55)), "ab": byte(F.col("lab_a") + num(128)), "bb": byte(F.col("lab_b") + num(128))})


def filled(sums: DataFrame) -> DataFrame:
    """Curves of ch, v, mean (null where there is no pixel): held on, led in from 0, made monotone; the identity for no pixels."""
    w = W.partitionBy("ch").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("ch")
    df = sums.withColumns({"held": F.last("mean", True).over(w), "first": F.min(F.when(F.col("mean").isNotNull(), F.col("v"))).over(whole), "start": byte(F.min_by("mean", F.when(F.col("mean").isNotNull(), F.col("v"))).over(whole))})
    raw = F.when(F.col("first").isNull(), F.col("v")).when(F.col("v") < F.col("first"), half_up(F.col("v") / F.col("first") * F.col("start"))).otherwise(byte(F.col("held")))
    return df.withColumn("raw", raw).select("ch", "v", F.max("raw").over(w).alias("out"))


def fit_lab(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """The Lab channels are specified, each target pixel is mapped by them, and outputs are averaged by input value."""
    names = ("lb", "ab", "bb")
    s, t = lab_bins(src.filter(F.col("a") >= OPAQUE)), lab_bins(tgt.filter(F.col("a") >= OPAQUE))
    maps = arrays(specify(cdf(histogram(s, names)), cdf(histogram(t, names))), names)
    m = t.crossJoin(F.broadcast(maps.select(*[F.col(c).alias(f"m_{c}") for c in names])))
    at = lambda c: F.element_at(f"m_{c}", F.col(c) + 1)
    m = with_rgb(m, at("lb") / num(2.55), at("ab") - num(128), at("bb") - num(128), ("o_r", "o_g", "o_b"))
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v"), F.col(f"o_{c}").alias("o")) for c in "rgb"])).alias("x")).select("x.*")
    means = rows.groupBy("ch", "v").agg((F.sum("o") / F.count("*")).alias("mean"))
    dense = axis(src).select(F.explode(F.array(*map(F.lit, "rgb"))).alias("ch"), "v")
    return filled(dense.join(means, ["ch", "v"], "left"))


def fit(src: DataFrame, tgt: DataFrame, mode: str = "full", color_space: str = "rgb") -> DataFrame:
    """The colour space counts for mode full only."""
    if mode == "full":
        return fit_lab(src, tgt) if color_space == "lab" else fit_full(src, tgt)
    return {"mean": fit_mean, "median": fit_median, "percentiles": fit_percentiles}[mode](src, tgt)


def arrays(curves: DataFrame, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """One row with each channel's 256 outputs as an array."""
    return curves.groupBy().agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("ch") == c, F.struct("v", "out")))), lambda s: s["out"]).alias(c) for c in names])


def luma_bins(px: DataFrame) -> DataFrame:
    """l, n and sums of r, g, b by luma, of visible pixels."""
    seen = px.filter(F.col("a") >= VISIBLE).groupBy(half_up(luma(F.col("r"), F.col("g"), F.col("b"))).alias("v")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "rgb"])
    return axis(px).join(seen, "v", "left").select(F.col("v").alias("l"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "sum_r", "sum_g", "sum_b")])


def luma_range(bins: DataFrame, least: float = 0.005) -> DataFrame:
    """First and last bin with more than a share of the highest; one row."""
    top = bins.select(F.max("n").alias("top"))
    found = bins.crossJoin(F.broadcast(top)).filter(F.col("n") > F.col("top") * num(least)).agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    lo = F.coalesce("lo", F.lit(0))
    return found.select(lo.alias("range_start"), F.greatest(lo + 1, F.coalesce("hi", F.lit(255))).alias("range_end"))


def luma_bars(px: DataFrame) -> DataFrame:
    """l and h: bars of log counts over the highest, at most 256 rows."""
    b = luma_bins(px).withColumn("h", F.log1p("n"))
    top = b.agg(F.max("h").alias("top"))
    return b.crossJoin(F.broadcast(top)).select("l", (F.col("h") / F.when(F.col("top") > 0, F.col("top")).otherwise(num(1))).alias("h"))
