import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import spatial as S
from tessera.sources import images as I
from tessera.sources import tiles as T

RECT = "struct<left: int, top: int, right: int, bottom: int>"


def rects(rng, n):
    out = []
    for i in range(n):
        side = rng.choice([0, 1, 1, 3, 17, 64, 1000])
        x, y = rng.randint(-500, 500), rng.randint(-500, 500)
        out.append((i, (x, y, x + rng.randint(0, side), y + rng.randint(0, side))))
    return [*out, (n, None), (n + 1, (-(2**31), -(2**31), 2**31 - 1, 2**31 - 1)), (n + 2, (5, 5, 4, 9))]


def meet(p, q):
    return bool(p and q) and min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1])


def test_rect_join_equals_all_pairs(spark):
    rng = random.Random(2)
    a, b = rects(rng, 150), rects(rng, 120)
    got = S.rect_join(spark.createDataFrame(a, f"i long, a {RECT}"), spark.createDataFrame(b, f"j long, b {RECT}"))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    rows = sorted((r["i"], r["j"]) for r in got.collect())
    assert rows == sorted((i, j) for i, p in a for j, q in b if p and p[2] > p[0] and p[3] > p[1] and q and q[2] > q[0] and q[3] > q[1] and meet(p, q))


def test_a_rectangle_has_few_cells_and_empty_sides_work(spark):
    a = spark.createDataFrame([(1, (0, 0, 2**30, 3))], f"i long, a {RECT}")
    assert S.in_cells(a, "a", list(range(33))).groupBy("_grid").count().agg(F.max("count")).first()[0] <= 4
    assert S.rect_join(a, spark.createDataFrame([], f"j long, b {RECT}")).count() == 0


def scanned(df):
    """Files that the scans of a collected plan read."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_rectangle_reads_skip_files(spark, tmp_path):
    px = spark.range(128 * 128).select((F.col("id") % 128).cast("int").alias("x"), F.floor(F.col("id") / 128).cast("int").alias("y"), F.col("id").alias("v"))
    T.write_tiles(px, f"{tmp_path}/t", 32, 8)
    whole = len(list(tmp_path.glob("t/*/*/*.parquet")))
    assert whole >= 16
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rect, blocks in (((3, 70, 30, 90), 1), ((31, 31, 33, 33), 4), ((0, 0, 128, 128), 16), ((5, 5, 5, 9), 0), ((200, 0, 210, 9), 0)):
            left, top, right, bottom = rect
            got = T.read_rect(spark, f"{tmp_path}/t", *rect, block=32)
            rows = {(r["x"], r["y"], r["v"]) for r in got.collect()}
            assert rows == {(x, y, y * 128 + x) for x in range(left, min(right, 128)) for y in range(top, min(bottom, 128))}
            in_blocks = sum(len(list(tmp_path.glob(f"t/block_y={by}/block_x={bx}/*.parquet"))) for by in range(4) for bx in range(4) if meet((bx * 32, by * 32, bx * 32 + 32, by * 32 + 32), rect))
            assert (scanned(got) if blocks else 0) == in_blocks and in_blocks >= blocks
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    with pytest.raises(ValueError):
        T.write_tiles(px, f"{tmp_path}/u", 30, 8)


def test_layers_share_blocks_over_many_files(spark, tmp_path):
    px = spark.range(40_000).select((F.col("id") % 10).cast("int").alias("x"), (F.col("id") % 7).cast("int").alias("y"), F.floor(F.col("id") / 4000).alias("layer"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    T.write_tiles(px, f"{tmp_path}/t", 32, 8, "layer")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("t/block_y=0/block_x=0/*.parquet"))) >= 3
    assert T.read_rect(spark, f"{tmp_path}/t", 0, 0, 32, 32, 32).groupBy("layer").count().filter("count = 4000").count() == 10


def encoded(spark, kind, image_type, argb, width):
    """A file of Java's own encoders, and the pixels that its decoder finds in it."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, len(argb) // width, getattr(jvm.java.awt.image.BufferedImage, image_type))
    for i, v in enumerate(argb):
        image.setRGB(i % width, i // width, v - (1 << 32) if v >= 1 << 31 else v)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    content = bytes(out.toByteArray())
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(content))
    return content, [read.getRGB(i % width, i // width) & 0xFFFFFFFF for i in range(len(argb))]


@pytest.mark.parametrize(("kind", "image_type"), [("png", "TYPE_4BYTE_ABGR"), ("png", "TYPE_3BYTE_BGR"), ("png", "TYPE_BYTE_GRAY"), ("png", "TYPE_BYTE_INDEXED"), ("jpg", "TYPE_3BYTE_BGR"), ("gif", "TYPE_BYTE_INDEXED"), ("bmp", "TYPE_3BYTE_BGR"), ("tiff", "TYPE_3BYTE_BGR")])
def test_images_of_every_kind(spark, tmp_path, kind, image_type):
    rng = random.Random(kind)
    width = 37
    argb = [rng.getrandbits(32) if image_type == "TYPE_4BYTE_ABGR" else 0xFF000000 | rng.getrandbits(24) for _ in range(width * 23)]
    content, want = encoded(spark, kind, image_type, argb, width)
    files = spark.createDataFrame([(f"one.{kind}", bytearray(content)), ("broken.png", bytearray(b"\x89PNG\r\n\x1a\nno")), ("empty.jpg", bytearray())], "name string, content binary")
    I.write_files(files, f"{tmp_path}/out")
    rows = I.pixels(I.read_images(spark, f"{tmp_path}/out")).collect()
    bad = [r for r in rows if r["error"]]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in bad) == ["broken.png"] and all(r["x"] is None for r in bad)
    good = {(r["x"], r["y"]): r for r in rows if not r["error"]}
    assert len(good) == width * 23
    for i, v in enumerate(want):
        r = good[i % width, i // width]
        grey = image_type == "TYPE_BYTE_GRAY"
        assert r["a"] == v >> 24 and (grey or (r["r"], r["g"], r["b"]) == (v >> 16 & 255, v >> 8 & 255, v & 255))
        assert not grey or r["r"] == r["g"] == r["b"]


def test_images_larger_than_a_band(spark, tmp_path):
    content, want = encoded(spark, "png", "TYPE_3BYTE_BGR", [0xFF000000 | i * 7 for i in range(300 * 250)], 300)
    I.write_files(spark.createDataFrame([("a.png", bytearray(content))], "name string, content binary"), f"{tmp_path}/o")
    px = I.pixels(I.read_images(spark, f"{tmp_path}/o"))
    assert px.count() == 75_000 and px.filter(F.col("r") * 65536 + F.col("g") * 256 + F.col("b") != (F.col("y") * 300 + F.col("x")) * 7).count() == 0


def test_files_are_all_or_none(spark, tmp_path):
    schema = "name string, content binary"
    I.write_files(spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], schema), f"{tmp_path}/o")
    bad = spark.createDataFrame([("c", bytearray(b"3")), ("d", bytearray(b"3")), ("../e", bytearray(b"4"))], schema).repartition(3)
    for df in (bad, spark.createDataFrame([("c", bytearray(b"3"))] * 2, schema)):
        with pytest.raises(Exception, match="file name|one name"):
            I.write_files(df, f"{tmp_path}/o")
        assert sorted(p.name for p in tmp_path.glob("o/*")) == ["a", "b"]
    I.write_files(spark.createDataFrame([("b", bytearray(b"5"))], schema), f"{tmp_path}/o", overwrite=True)
    assert [(p.name, p.read_bytes()) for p in tmp_path.glob("o/*")] == [("b", b"5")]
