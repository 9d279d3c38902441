"""Palettes: k-means in Lab, distances to clusters, hard and soft weights, weighted sources, masks and palette bars.

A palette is a short list (at most a few dozen clusters) that comes as Python values; pixels meet it as literals, so no join is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.color import byte, half_up, hash01, luma, num, pack, with_lab, with_rgb

from .pixels import LABELS
from .pixels import preset as blend

STRIDE, ROUNDS, SETTLED, SOFT_BASE = 4, 12, 0.5, 5000.0
SOURCE_PIXELS, LEAST_WIDTH = 4096, 1.5
Cluster = tuple[float, float, float]


def samples(px: DataFrame, stride: int = STRIDE) -> DataFrame:
    """px_id and Lab of every stride-th pixel, where opaque."""
    return with_lab(px.filter((F.col("px_id") % stride == 0) & (F.col("a") >= 128))).select("px_id", "lab_l", "lab_a", "lab_b")


def nth_rows(df: DataFrame, key: str, places: list[int], ranges: int = 1024) -> list:
    """The rows at the given places (from 0) in the order of a whole-number key with distinct values.

    Keys are counted by equal ranges, at most so many rows on the driver; only the ranges that hold a place are sorted."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    width = (hi - lo) // ranges + 1
    part = F.floor((F.col(key) - F.lit(lo)) / width)
    counts = {r["p"]: r["count"] for r in df.groupBy(part.alias("p")).count().collect()}
    wanted, before = [], 0
    for p in sorted(counts):
        wanted += [(p, n - before + 1) for n in places if before <= n < before + counts[p]]
        before += counts[p]
    inside = df.withColumn("_p", part).filter(F.col("_p").isin(sorted({p for p, _ in wanted})))
    ranked = inside.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(key)))
    hit = F.lit(False)
    for p, n in wanted:
        hit = hit | ((F.col("_p") == p) & (F.col("_n") == n))
    return ranked.filter(hit).orderBy(key).drop("_p", "_n").collect()


def nearest(clusters: list[Cluster]) -> Column:
    """The number of the nearest cluster, the first among equals."""
    d = F.array(*[square(c) for c in clusters])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def square(c: Cluster) -> Column:
    parts = [F.col(n) - num(v) for n, v in zip(("lab_l", "lab_a", "lab_b"), c, strict=True)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def kmeans(px: DataFrame, k: int = 5) -> DataFrame:
    """ord, r, g, b, weight, lab_l, lab_a, lab_b by falling weight. Begins with evenly placed samples; a cluster without samples keeps its centre; ends after ROUNDS or when centres move by less than SETTLED on average. Weights are those of the last assignment."""
    spark = px.sparkSession
    s = samples(px).persist()
    n = s.count()
    schema = "ord int, weight double, l double, a double, b double"
    if n <= k:
        found = [(i, 1 / n, r["lab_l"], r["lab_a"], r["lab_b"]) for i, r in enumerate(s.orderBy("px_id").collect())]
    else:
        rows = nth_rows(s, "px_id", [math.floor((c + 0.5) / k * n) for c in range(k)])
        centres = [(r["lab_l"], r["lab_a"], r["lab_b"]) for r in rows]
        counts: dict[int, int] = {}
        for _ in range(ROUNDS):
            sums = s.groupBy(nearest(centres).alias("c")).agg(F.count("*").alias("n"), *[F.avg(f"lab_{x}").alias(x) for x in "lab"]).collect()
            counts, moved = {r["c"]: r["n"] for r in sums}, 0.0
            for r in sums:
                new = (r["l"], r["a"], r["b"])
                moved += math.dist(new, centres[r["c"]])
                centres[r["c"]] = new
            if moved / k < SETTLED:
                break
        order = sorted(counts, key=lambda c: (-counts[c], c))
        found = [(i, counts[c] / n, *map(float, centres[c])) for i, c in enumerate(order)]
    s.unpersist()
    df = with_rgb(spark.createDataFrame(found, schema), F.col("l"), F.col("a"), F.col("b"), ("red", "green", "blue"))
    return df.select("ord", F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b"), "weight", F.col("l").alias("lab_l"), F.col("a").alias("lab_a"), F.col("b").alias("lab_b"))


def with_distances(px: DataFrame, clusters: list[Cluster]) -> DataFrame:
    """px with d, the squared Lab distances to the clusters; null for transparent pixels."""
    df = with_lab(px)
    return df.withColumn("d", F.when(F.col("a") >= 128, F.array(*[square(c) for c in clusters]))).drop("lab_l", "lab_a", "lab_b")


def long_distances(df: DataFrame) -> DataFrame:
    """px_id, k, d of opaque pixels. The outer form keeps Spark from computing the distances once more for a filter of its own."""
    return df.select("px_id", F.posexplode_outer("d").alias("k", "d")).filter("k IS NOT NULL")


def effective_weight(weights: list[float], softness: float = 0) -> Column:
    """From d: the nearest cluster's weight, or a mean weighted by 1 / (1 + (d - least) / s²); 0 for transparent pixels."""
    if not weights:
        return num(0)
    d, w = F.col("d"), F.array(*map(num, weights))
    least = F.array_min(d)
    if softness <= 0:
        out = F.element_at(w, F.array_position(d, least).cast("int"))
    else:
        scale = num(1 / ((softness / 100) ** 2 * SOFT_BASE))
        share = F.transform(d, lambda x: num(1) / (num(1) + (x - least) * scale))
        total = lambda a: F.aggregate(a, num(0), lambda acc, x: acc + x)
        out = total(F.zip_with(share, w, lambda g, x: g * x)) / total(share)
    return F.when(d.isNull(), num(0)).otherwise(out)


def copies(weight: Column, index: Column) -> Column:
    """How often a pixel of this weight is emitted: its whole part, and one more for a share of pixels; at most 255."""
    w = F.greatest(num(0), weight)
    return F.least(F.lit(255), F.floor(w).cast("int") + (hash01(index) < w - F.floor(w)).cast("int"))


def weighted_source(px: DataFrame, weight: str) -> DataFrame:
    """Pixels repeated by weight, numbered by copy."""
    n = copies(F.col(weight), F.col("px_id"))
    numbers = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: i > 0)  # none for 0, so no filter has to be computed apart
    return px.withColumn("n", n).withColumn("copy", F.explode(numbers)).drop("n")


def weighted_histogram(px: DataFrame, weight: str) -> DataFrame:
    """ch, v, n of the weighted source, summed without repeating a pixel."""
    rows = px.filter("a >= 128").select(copies(F.col(weight), F.col("px_id")).alias("n"), F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in "rgb"])).alias("x"))
    return rows.groupBy("x.ch", "x.v").agg(F.sum("n").alias("n")).filter("n > 0")


def palette_mask(weights: list[float], softness: float = 0) -> Column:
    return half_up(effective_weight([min(1.0, max(0.0, w)) for w in weights], softness) * num(255))


def weights_active(weights: Column) -> Column:
    return F.exists(weights, lambda w: F.abs(w - num(1)) > num(0.01))


def bar(swatches: DataFrame, owner: str) -> DataFrame:
    """swatches(owner, idx, r, g, b, weight, user) -> owner, idx, ord (dark to light), value, width and left in percent of the owner's bar. A palette is few rows; owners spread over all tasks."""
    one = W.partitionBy(owner)
    df = swatches.withColumns({"value": F.greatest(num(0), F.col("user")) * F.greatest(num(0), F.col("weight")), "y": luma(F.col("r"), F.col("g"), F.col("b"))})
    total = F.sum("value").over(one)
    df = df.withColumn("width", F.greatest(num(LEAST_WIDTH), F.col("value") / F.when(total == 0, num(1)).otherwise(total) * num(100)))
    df = df.withColumn("width", F.col("width") / F.sum("width").over(one) * num(100))
    order = one.orderBy("y", "idx")
    return df.withColumns({"ord": F.row_number().over(order) - 1, "left": F.coalesce(F.sum("width").over(order.rowsBetween(W.unboundedPreceding, -1)), num(0))}).drop("y")


def drag_pair(bars: DataFrame, owner: str, place: int, x: float) -> DataFrame:
    """owner, idx and new user weight after the handle between place and place + 1 went to x percent; the pair's sum of weight times prevalence stays. Palettes without that handle stay as they are."""
    one = W.partitionBy(owner)
    both = F.col("ord").isin(place, place + 1)
    of = lambda f, c: f(F.when(both, c)).over(one)
    p = F.greatest(num(1e-6), F.col("weight"))
    df = bars.withColumns({"mass": of(F.sum, F.col("user") * p), "from": of(F.min, F.col("left")), "to": of(F.max, F.col("left") + F.col("width")), "pair": of(F.count, F.col("idx"))})
    share = (F.greatest(F.col("from") + num(0.5), F.least(F.col("to") - num(0.5), num(x))) - F.col("from")) / (F.col("to") - F.col("from"))
    new = F.when(F.col("ord") == place, F.col("mass") * share / p).when(F.col("ord") == place + 1, F.col("mass") * (num(1) - share) / p)
    return df.select(owner, "idx", F.when(both & (F.col("pair") == 2), new).otherwise(F.col("user")).alias("user"))


def drag_body(bars: DataFrame, owner: str, place: int, dx: float) -> DataFrame:
    """owner, idx and new user weight after the swatch at place grew by dx of the bar; the others keep their ratios, or share by prevalence if they had nothing. Palettes without that place stay as they are."""
    one = W.partitionBy(owner)
    others = F.when(F.col("ord") != place, F.greatest(num(0), F.col("weight"))).otherwise(num(0))
    df = bars.withColumns({"total": F.sum("value").over(one), "own": F.max(F.when(F.col("ord") == place, F.col("value"))).over(one), "others": F.sum(others).over(one)})
    df = df.withColumn("total", F.when(F.col("total") == 0, num(1)).otherwise(F.col("total")))
    before = F.col("own") / F.col("total")
    after = F.greatest(num(0), F.least(num(1), before + num(dx)))
    mine = after * F.col("total") / F.greatest(num(1e-6), F.col("weight"))
    rest = F.when(num(1) - before >= num(1e-6), F.col("user") * (num(1) - after) / (num(1) - before)).when(F.col("others") > num(1e-6), (num(1) - after) / F.col("others")).otherwise(F.col("user"))
    return df.select(owner, "idx", F.when(F.col("own").isNull(), F.col("user")).when(F.col("ord") == place, mine).otherwise(rest).alias("user"))


def display_color(preset: str) -> tuple[Column, Column, Column]:
    """How a swatch is shown: its luma for contrast, levelled to a luma of 140 for hue, else itself."""
    own = tuple(map(F.col, "rgb"))
    y = luma(*own)
    if preset == "contrast":
        return (half_up(y),) * 3
    if preset == "hue":
        return tuple(F.when(y < 1, F.lit(140)).otherwise(byte(c * (num(140) / y))) for c in own)
    return own


def edges(bars: DataFrame, owner: str, preset: str) -> DataFrame:
    """owner, idx, right, r, g, b: the colour between a swatch and the next one of the bar, the mean of both as shown; none after the last."""
    by = W.partitionBy(owner).orderBy("ord")
    shown = bars.select(owner, "idx", "ord", *[c.alias(n) for c, n in zip(display_color(preset), "rgb", strict=True)])
    df = shown.withColumns({"right": F.lead("idx").over(by), **{f"n_{c}": F.lead(c).over(by) for c in "rgb"}}).filter("right IS NOT NULL")
    return df.select(owner, "idx", "right", *[half_up((F.col(c) + F.col(f"n_{c}")) / num(2)).alias(c) for c in "rgb"])


def recipe_source(swatches: DataFrame, owner: str, total: int = SOURCE_PIXELS) -> DataFrame:
    """owner, px_id, r, g, b, a: a source of a fixed number of pixels in the swatches' shares, at least one each while there is room, filled up with the first."""
    one = W.partitionBy(owner)
    order = one.orderBy("idx")
    value = F.greatest(num(0), F.coalesce("user", num(1))) * F.greatest(num(0), F.coalesce("weight", num(1)))
    df = swatches.withColumn("value", value)
    whole = F.sum("value").over(one)
    df = df.withColumn("n", F.greatest(F.lit(1), half_up(F.col("value") / F.when(whole == 0, num(1)).otherwise(whole) * num(total))))
    df = df.withColumn("end", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    df = df.withColumns({"from": F.col("end") - F.col("n"), "to": F.least(F.lit(total), F.col("end")), "rest": F.when(F.row_number().over(order) == 1, F.greatest(F.lit(0), F.lit(total) - F.max("end").over(one)))})
    ids = lambda lo, hi: F.when(hi > lo, F.sequence(lo.cast("bigint"), hi.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    filled = F.concat(ids(F.col("from"), F.col("to")), ids(F.lit(total) - F.coalesce("rest", F.lit(0)), F.lit(total)))
    return df.select(owner, F.explode(filled).alias("px_id"), *"rgb", F.lit(255).alias("a"))


STOPS = 32
#: What an empty palette stands for.
NO_COLOR = 0x888888


def clamp_byte(c: Column) -> Column:
    """Rounded into a byte; what is no number is 0."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(half_up(F.greatest(num(0), F.least(num(255), x))))


def shown_palette(source: Column, target: Column) -> Column:
    """The source's swatches, or the target's where there are none, or no swatch."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(source), some(target), source, target)


def gradient_stops(states: DataFrame, key: str, palette: Column, preset: Column, n: int = STOPS) -> DataFrame:
    """One row per state and stop: key, i, r, g, b, pct. Each grey stop takes the swatch of nearest lightness (the first among equals), blended by the state's preset; without swatches it stays grey.

    palette: array<struct<r,g,b,labL>>. States are few numbers each; stops are made by explode, without a shuffle."""
    grey = half_up(F.col("i") / num(n - 1) * num(255))
    df = states.select(key, palette.alias("_p"), F.coalesce(preset, F.lit("color")).alias("_preset"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    df = df.withColumn("_g", grey)
    light = F.col("_g") / num(255) * num(100)
    far = lambda s: F.coalesce(F.abs(F.when(~F.isnan(s["labL"].cast("double")), s["labL"]).cast("double") - light), num(1e9))
    ranked = F.transform("_p", lambda s, k: F.struct(far(s).alias("far"), k.alias("k"), *[clamp_byte(s[c]).alias(c) for c in "rgb"]))
    best = F.array_min(ranked)
    df = df.withColumn("_s", best).select(key, "i", "_preset", *[F.col("_g").alias(c) for c in "rgb"], *[F.coalesce(F.col("_s")[c], F.col("_g")).alias(f"m_{c}") for c in "rgb"])
    parts = None
    for name in LABELS:
        known = F.col("_preset").isin(*LABELS)
        part = blend(df.filter((F.col("_preset") == name) | (~known if name == "color" else F.lit(False))), name)
        parts = part if parts is None else parts.unionByName(part)
    return parts.select(key, "i", *"rgb", F.format_string("%.6f", F.col("i") / num(n - 1) * num(100)).alias("pct"))


def gradient_css(stops: DataFrame, key: str) -> DataFrame:
    """key and css of stops(key, i, r, g, b, pct)."""
    part = F.format_string("rgb(%d,%d,%d) %s%%", F.col("r"), F.col("g"), F.col("b"), F.col("pct"))
    one = stops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))).alias("x"))
    return one.select(key, F.concat(F.lit("linear-gradient(to right, "), F.array_join(F.transform("x", lambda x: x["p"]), ", "), F.lit(")")).alias("css"))


def signature(palette: Column, user: Column) -> Column:
    """struct<colors, weights>: packed colours, and prevalence times user weight (1 where there is none, never below 0) in hundredths; an empty palette is one grey of weight 100."""
    whole = lambda c: F.when(c.isNull() | F.isnan(c.cast("double")), num(0)).otherwise(c.cast("double"))
    mult = lambda i: F.greatest(num(0), F.coalesce(F.when(~F.isnan(F.get(user, i)), F.get(user, i)), num(1)))
    known = F.filter(F.transform(palette, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"].isNotNull())
    colors = F.transform(known, lambda x: pack(*[clamp_byte(x["s"][c]) for c in "rgb"]))
    weights = F.transform(known, lambda x: half_up(whole(x["s"]["weight"]) * mult(x["i"]) * num(100)))
    empty = F.coalesce(F.size(known), F.lit(0)) < 1
    return F.struct(F.when(empty, F.array(F.lit(NO_COLOR))).otherwise(colors).alias("colors"), F.when(empty, F.array(F.lit(100))).otherwise(weights).alias("weights"))
