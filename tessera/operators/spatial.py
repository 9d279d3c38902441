"""Rectangles against rectangles: all pairs that share a pixel, by equality joins on grid cells.

A rectangle has a level, the least k with sides of at most 2^k, and covers at most four cells of 2^k; the same holds for every
coarser grid. Two rectangles meet in the grid of the larger one's level: each is listed in its cells of its own level and of the
other side's levels above it, at most four rows a level, however large it is. A pair may share several cells; the one that holds
the corner of least x and y of what they share reports it. Pairs of no common cell are never made, and a cell that very many
rectangles share is a skewed key of an ordinary equality join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_of(rect: Column) -> Column:
    """The least k with 2^k >= both sides; null for an empty rectangle."""
    side = F.greatest(rect["right"].cast("long") - rect["left"], rect["bottom"].cast("long") - rect["top"])
    empty = (rect["right"] <= rect["left"]) | (rect["bottom"] <= rect["top"])
    return F.when(~empty, F.when(side <= 1, 0).otherwise(F.length(F.conv((side - 1).cast("string"), 10, 2))))


def cell(c: Column) -> Column:
    """The cell of a coordinate in the grid of its row."""
    return F.call_function("shiftright", c.cast("long"), F.col("_grid"))


def in_cells(df: DataFrame, rect: str, levels: list[int]) -> DataFrame:
    """A row for every cell of the rectangle's own level and of the given ones above it: _level is its own, _grid the cells' level."""
    own = df.withColumn("_level", level_of(F.col(rect))).filter("_level IS NOT NULL")
    above = F.filter(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>"), lambda k: k > F.col("_level"))
    listed = own.withColumn("_grid", F.explode(F.concat(F.array("_level"), above)))
    cells = lambda lo, hi: F.sequence(cell(F.col(f"{rect}.{lo}")), cell(F.col(f"{rect}.{hi}").cast("long") - 1))
    return listed.withColumn("_cx", F.explode(cells("left", "right"))).withColumn("_cy", F.explode(cells("top", "bottom")))


def rect_join(a: DataFrame, b: DataFrame, rect_a: str = "a", rect_b: str = "b") -> DataFrame:
    """All columns of a and b for every pair whose rectangles (structs of left, top, right, bottom) share a pixel, once. Empty or null rectangles meet nothing."""
    levels = [sorted(r[0] for r in df.select(level_of(F.col(c)).alias("k")).filter("k IS NOT NULL").distinct().collect()) for df, c in ((a, rect_a), (b, rect_b))]  # at most 33 numbers a side
    left = in_cells(a, rect_a, levels[1]).withColumnRenamed("_level", "_level_a")
    right = in_cells(b, rect_b, levels[0]).withColumnRenamed("_level", "_level_b")
    pairs = left.join(right, ["_grid", "_cx", "_cy"])
    p, q = F.col(rect_a), F.col(rect_b)
    share = (F.least(p["right"], q["right"]) > F.greatest(p["left"], q["left"])) & (F.least(p["bottom"], q["bottom"]) > F.greatest(p["top"], q["top"]))
    corner = [cell(F.greatest(p[s], q[s])) for s in ("left", "top")]
    once = (F.col("_grid") == F.greatest("_level_a", "_level_b")) & (F.col("_cx") == corner[0]) & (F.col("_cy") == corner[1])
    return pairs.filter(once & share).drop("_grid", "_cx", "_cy", "_level_a", "_level_b")

