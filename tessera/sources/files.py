"""File sources and sinks: image files, settings, lookup-table texts and profiles, PNG tiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.recipes import STATE

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp")
TILE_ROWS = 64


def images(spark: SparkSession, path: str) -> DataFrame:
    """path and content of image files, by Spark's binary source; the ending decides."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*IMAGES)).select("path", "length", "content")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings documents, one JSON object per line; a line that is none gives nulls."""
    return spark.read.schema(f"state {STATE}, name string, saved_ms bigint").option("mode", "PERMISSIVE").json(path)


def write_settings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """line_no, line as one text in order. A .cube of 65 nodes a side has 274,631 lines at most, so one task is bounded."""
    lines.repartition(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


# Where a device link's prefix tells the whole size, its table tag's length and its grid, and what that tag holds beside the table.
SIZE_AT, TAG_LENGTH_AT, GRID_AT, TAG_BESIDE = 0, 164, 0x13E, 76


def sized_prefix(prefix: bytes, suffix: bytes, grid: int, beside: int = TAG_BESIDE) -> bytes:
    """The prefix of a device link with the whole size, the tag's length and the grid patched in."""
    if not 2 <= grid <= 256:
        raise ValueError(f"a grid of {grid} is not between 2 and 256")
    table = 6 * grid**3
    out = bytearray(prefix)
    struct.pack_into(">I", out, SIZE_AT, len(prefix) + table + len(suffix))
    struct.pack_into(">I", out, TAG_LENGTH_AT, table + beside)
    out[GRID_AT] = grid & 255
    return bytes(out)


def profile(clut: DataFrame, prefix: bytes, suffix: bytes) -> DataFrame:
    """One row with the binary of a device link: prefix (see sized_prefix), table by node, suffix. The table's size follows from the grid's alone."""
    body = clut.agg(F.array_sort(F.collect_list(F.struct("node", "hex"))).alias("x")).select(F.unhex(F.array_join(F.transform("x", lambda n: n["hex"]), "")).alias("body"))
    return body.select(F.concat(F.lit(bytearray(prefix)), "body", F.lit(bytearray(suffix))).alias("profile"))


def data_url(c: Column, kind: str) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(c))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """An uncompressed PNG of RGBA bytes."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + rgba[i : i + 4 * width] for i in range(0, len(rgba), 4 * width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 0)) + chunk(b"IEND", b"")


def png_tiles(px: DataFrame, width: int) -> DataFrame:
    """tile, height, png: bands of TILE_ROWS rows of an image, each a PNG of its own, so that no task holds a whole image. Missing pixels are transparent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for tile, x, y, pixels in f.itertuples(index=False):
                x, y = np.asarray(x), np.asarray(y)
                image = np.zeros((int(y.max()) % TILE_ROWS + 1, width), ">u4")
                image[y % TILE_ROWS, x] = pixels
                out.append((tile, len(image), png(width, len(image), image.tobytes())))
            yield pd.DataFrame(out, columns=["tile", "height", "png"])

    packed = (F.col("r").cast("long") * 16777216 + F.col("g").cast("long") * 65536 + F.col("b").cast("long") * 256 + F.col("a").cast("long")).alias("p")
    tiles = px.groupBy(F.floor(F.col("y") / TILE_ROWS).cast("long").alias("tile")).agg(*[F.collect_list(c).alias(n) for c, n in (("x", "x"), ("y", "y"))], F.collect_list(packed).alias("pixels"))
    return tiles.mapInPandas(run, "tile long, height int, png binary")


