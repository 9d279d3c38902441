"""Queries of image files, tiled pixels and rectangles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.raster import rect
from tessera.operators.spatial import rect_join
from tessera.sources.files import png_tiles
from tessera.sources.fixtures import table
from tessera.sources.fixtures import target_pixels as tgt
from tessera.sources.images import pixels, read_images, write_files
from tessera.sources.shared import shared_dir
from tessera.sources.tiles import read_rect, write_tiles

from .sqltext import TGT

WIDTH, BLOCK, TILE = 100, 32, 8
WINDOW = (20, 2, 70, 61)


def new_folder(s, name):
    return f"{shared_dir(s).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def image_decode(s, d):
    """The target image as PNG files of 64 rows, read back as pixels."""
    path = new_folder(s, "images")
    write_files(png_tiles(tgt(s, d), WIDTH).select(F.format_string("tile-%d.png", "tile").alias("name"), F.col("png").alias("content")), path)
    px = pixels(read_images(s, path))
    tile = F.regexp_extract("path", r"tile-(\d+)\.png$", 1).cast("int")
    return px.select("x", (tile * 64 + F.col("y")).alias("y"), *"rgba", "error")


def tile_rect_read(s, d):
    path = new_folder(s, "tiles")
    write_tiles(tgt(s, d), path, BLOCK, TILE)
    return read_rect(s, path, *WINDOW, block=BLOCK).select("px_id", "x", "y", *"rgba")


def shapes(s, d):
    """A rectangle a pixel, and a selection a supplier: some thin, some wide, some empty."""
    px = tgt(s, d).select("px_id", rect(F.col("x"), F.col("y"), F.col("x") + F.col("r") % 30, F.col("y") + F.col("g") % 30).alias("a"))
    k, x, y = F.col("s_suppkey"), F.col("s_suppkey") * 37 % 120 - 10, F.col("s_suppkey") * 7 % 1100 - 10
    return px, table(s, d, "supplier").select("s_suppkey", rect(x, y, x + k % 40, y + k * 7 % 25).alias("b"))


def rect_pairs(s, d):
    return rect_join(*shapes(s, d)).select("px_id", "s_suppkey")


QUERIES = {"image_decode": image_decode, "tile_rect_read": tile_rect_read, "rect_join": rect_pairs}
SQL = {
    "image_decode": f"""WITH {TGT}, g AS (SELECT CAST(i AS INT) x, CAST(j AS INT) y FROM (SELECT range i FROM range({WIDTH})), (SELECT unnest(range((SELECT max(y) + 1 FROM tgt))) j))
SELECT g.x, g.y, {', '.join(f'coalesce({c}, 0) {c}' for c in 'rgba')}, CAST(NULL AS VARCHAR) error FROM g LEFT JOIN tgt USING (x, y)""",
    "tile_rect_read": f"WITH {TGT} SELECT px_id, x, y, r, g, b, a FROM tgt WHERE x >= {WINDOW[0]} AND y >= {WINDOW[1]} AND x < {WINDOW[2]} AND y < {WINDOW[3]}",
    "rect_join": f"""WITH {TGT}, p AS (SELECT px_id, x l, y t, x + r % 30 rr, y + g % 30 bb FROM tgt WHERE r % 30 > 0 AND g % 30 > 0),
s AS (SELECT s_suppkey, l, t, l + s_suppkey % 40 rr, t + s_suppkey*7 % 25 bb FROM (SELECT s_suppkey, s_suppkey*37 % 120 - 10 l, s_suppkey*7 % 1100 - 10 t FROM supplier) WHERE s_suppkey % 40 > 0 AND s_suppkey*7 % 25 > 0)
SELECT px_id, s_suppkey FROM p JOIN s ON p.l < s.rr AND s.l < p.rr AND p.t < s.bb AND s.t < p.bb""",
}
