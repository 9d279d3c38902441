"""Raster operators: rectangles, downsampling, masks aligned by position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import half_up, num

SIDES = ("left", "top", "right", "bottom")


def intersect(a: Column, b: Column) -> Column:
    """Common rectangle of two structs of sides, null if there is none."""
    parts = {"left": F.greatest(a["left"], b["left"]), "top": F.greatest(a["top"], b["top"]), "right": F.least(a["right"], b["right"]), "bottom": F.least(a["bottom"], b["bottom"])}
    return F.when((parts["right"] > parts["left"]) & (parts["bottom"] > parts["top"]), F.struct(*[parts[s].alias(s) for s in SIDES]))


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


def size_of(px: DataFrame) -> tuple[int, int]:
    """Width and height."""
    w, h = px.agg(F.max("x") + 1, F.max("y") + 1).first()
    return w or 0, h or 0


def _boxes(px: DataFrame, source: int, target: int, name: str) -> DataFrame:
    """Which output column or row each input one falls into: i for floor(i s) to floor((i + 1) s)."""
    s = num(source / target)
    edge = px.sparkSession.range(target).select(F.col("id").cast("int").alias(f"o{name}"))
    own = F.sequence(F.floor(F.col(f"o{name}") * s).cast("int"), F.least(F.lit(source), F.floor((F.col(f"o{name}") + 1) * s).cast("int")) - 1)
    return edge.select(f"o{name}", F.explode(own).alias(name))


def downsample(px: DataFrame, longest: int, size: tuple[int, int] | None = None) -> DataFrame:
    """x, y and means of r, g, b, a over boxes, cut to whole numbers; unchanged if the image is small enough. The box tables are as long as the image's sides."""
    w, h = size or size_of(px)
    scale = min(1.0, longest / max(w, h, 1))
    if scale >= 1:
        return px.select("x", "y", *"rgba")
    nw, nh = (max(1, math.floor(n * scale + 0.5)) for n in (w, h))
    df = px.join(F.broadcast(_boxes(px, w, nw, "x")), "x").join(F.broadcast(_boxes(px, h, nh, "y")), "y")
    return df.groupBy(F.col("ox").alias("x"), F.col("oy").alias("y")).agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in "rgba"])


def nearest_mask(mask: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """x, y, m of a mask scaled to the target size by nearest neighbours."""
    spark = mask.sparkSession
    axis = lambda n, m, c: spark.range(m).select(F.col("id").cast("int").alias(f"o{c}"), F.least(F.lit(n - 1), F.floor(F.col("id") / num(m) * num(n)).cast("int")).alias(c))
    grid = mask.select("x", "y", "m").join(F.broadcast(axis(source[0], target[0], "x")), "x").join(F.broadcast(axis(source[1], target[1], "y")), "y")
    return grid.select(F.col("ox").alias("x"), F.col("oy").alias("y"), "m")


def paste(grid: DataFrame, mask: DataFrame | None, dx: int = 0, dy: int = 0) -> DataFrame:
    """grid with m of a mask laid at (dx, dy); 0 outside it, also where they do not meet at all. Without a mask (no selection) m is null, which compose() takes for no mask."""
    if mask is None:
        return grid.withColumn("m", F.lit(None).cast("int"))
    laid = mask.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "m")
    return grid.join(laid, ["x", "y"], "left").withColumn("m", F.coalesce("m", F.lit(0)))


def selection_as_alpha(px: DataFrame, mask: DataFrame) -> DataFrame:
    return px.join(mask.select("px_id", "m"), "px_id", "left").withColumn("a", F.coalesce("m", F.lit(0))).drop("m")


def compose(mask: Column, selection: Column, mode: str = "focus") -> Column:
    """Product of two masks in 256ths; a missing selection leaves the mask."""
    if mode == "off":
        return mask
    s = selection if mode == "focus" else 255 - selection
    return F.when(selection.isNull(), mask).otherwise(F.shiftright(mask * s + 127, 8))


def preview(orig: Column, new: Column, selection: Column, mode: str = "focus") -> Column:
    w = selection / num(255) if mode == "focus" else num(1) - selection / num(255)
    return F.when(w >= num(0.999), new).when(w <= num(0.001), orig).otherwise(half_up(orig + (new - orig) * w))


def fit_length(mask: DataFrame, wanted: DataFrame) -> DataFrame:
    """A mask cut or filled with 0 to the wanted px_ids."""
    return wanted.select("px_id").join(mask.select("px_id", "m"), "px_id", "left").select("px_id", F.coalesce("m", F.lit(0)).alias("m"))


def full_mask(px: DataFrame) -> DataFrame:
    """px_id and m of a mask that lets all through."""
    return px.select("px_id", F.lit(255).alias("m"))
