"""A stored pixel relation whose reads of a rectangle touch only the files that meet it.

Pixels are cut into square blocks, the folders of the table, and within a block into tiles in Z-order, which keeps neighbours in
both directions near each other in a file. Rows are dealt by ranges of block, layer and place in the Z-order, so a block that
many layers share is spread over many tasks and files, each with narrow least and greatest values. A rectangle becomes ranges of
blocks, by which the scan skips folders, and ranges of x, y and layer, by which it skips row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, TILE = 1024, 32


def interleaved(x: Column, y: Column, bits: int) -> Column:
    """The bits of two whole numbers in turn, those of y higher: the place in the Z-order."""
    z = F.lit(0).cast("long")
    for k in range(bits):
        for shift, c in ((2 * k, x), (2 * k + 1, y)):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), shift))
    return z


def write_tiles(px: DataFrame, path: str, block: int = BLOCK, tile: int = TILE, layer: str | None = None) -> None:
    """px(x, y, any other columns) as a tiled table; block is a multiple of tile. Both are stored in the folder names' values only through block_x and block_y."""
    if block % tile:
        raise ValueError(f"blocks of {block} are not made of tiles of {tile}")
    inside = lambda c: F.floor(F.pmod(F.col(c), F.lit(block)) / tile)
    place = interleaved(inside("x"), inside("y"), max(1, (block // tile - 1).bit_length()))
    order = ["block_y", "block_x", *([layer] if layer else []), "_z"]
    cut = px.withColumns({"block_y": F.floor(F.col("y") / block).cast("int"), "block_x": F.floor(F.col("x") / block).cast("int"), "_z": place})
    dealt = cut.repartitionByRange(*order).sortWithinPartitions(*order, "y", "x").drop("_z")
    dealt.write.partitionBy("block_y", "block_x").parquet(path)


def read_rect(spark: SparkSession, path: str, left: int, top: int, right: int, bottom: int, block: int = BLOCK) -> DataFrame:
    """The pixels of a tiled table with left <= x < right and top <= y < bottom; block is what it was written with."""
    stored = spark.read.parquet(path)
    if right <= left or bottom <= top:
        return stored.filter(F.lit(False)).drop("block_x", "block_y")
    blocks = F.col("block_x").between(left // block, (right - 1) // block) & F.col("block_y").between(top // block, (bottom - 1) // block)
    return stored.filter(blocks & (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom)).drop("block_x", "block_y")
