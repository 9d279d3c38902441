"""Row-wise operators over pixels: curves applied, weighted, blended; preview variants; 3-D lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import byte, half_up, hsl_to_rgb, luma, num, rgb_to_hsl

from . import curves as C

RGB = ("r", "g", "b")
#: Blend presets by their names on the panel.
LABELS = {"color": "Full", "hue": "Color", "hueOnly": "Hue", "saturationOnly": "Saturation", "contrast": "Contrast"}


def mapped(px: DataFrame, curves: DataFrame, prefix: str = "m_") -> DataFrame:
    """px with the curves' outputs as m_r, m_g, m_b. curves is one row of three arrays."""
    one = F.broadcast(curves.select(*[F.col(c).alias(f"_curve_{c}") for c in RGB]))
    return px.crossJoin(one).withColumns({prefix + c: F.element_at(f"_curve_{c}", F.col(c) + 1) for c in RGB}).drop(*[f"_curve_{c}" for c in RGB])


def put(df: DataFrame, out: tuple[Column, Column, Column]) -> DataFrame:
    """df with new r, g, b; helper columns of the mapping go."""
    return df.withColumns(dict(zip(RGB, out, strict=True))).drop("m_r", "m_g", "m_b")


def apply_curves(px: DataFrame, curves: DataFrame) -> DataFrame:
    return put(mapped(px, curves), tuple(F.col(f"m_{c}") for c in RGB))


def weighted(orig: Column, new: Column, weight: Column) -> Column:
    """Blend in 256ths; the step is shifted, so it rounds down."""
    w = half_up(F.greatest(num(0), F.least(num(1), weight)) * num(256))
    return F.when(w == 256, new).when(w == 0, orig).otherwise(orig + F.shiftright((new - orig) * w, 8))


def apply_weighted(px: DataFrame, curves: DataFrame, weight: str) -> DataFrame:
    return put(mapped(px, curves), tuple(weighted(F.col(c), F.col(f"m_{c}"), F.col(weight)) for c in RGB))


def _hsl(df: DataFrame, prefix: str) -> DataFrame:
    h, s, l = rgb_to_hsl(*[F.col(prefix + c) for c in RGB])  # noqa: E741
    return df.withColumns({f"{prefix}H": h, f"{prefix}S": s, f"{prefix}L": l})


def preset_weighted(df: DataFrame, name: str, weight: str) -> DataFrame:
    """The preset's blend first, then as much of it as the weight says."""
    before = {f"_o_{c}": F.col(c) for c in RGB}
    out = preset(df.withColumns(before), name)
    return out.withColumns({c: weighted(F.col(f"_o_{c}"), F.col(c), F.col(weight)) for c in RGB}).drop(*before)


def preset(df: DataFrame, name: str) -> DataFrame:
    """Blends m_r, m_g, m_b into r, g, b: hue takes H and S, hueOnly H, saturationOnly S of the mapped colour and keeps the original luma; contrast takes the luma step alone; color all."""
    own, new = tuple(map(F.col, RGB)), tuple(F.col(f"m_{c}") for c in RGB)
    if name == "color":
        return put(df, new)
    if name == "contrast":
        step = luma(*new) - luma(*own)
        return put(df, tuple(byte(c + step) for c in own))
    df = _hsl(_hsl(df, ""), "m_")
    h = F.col("m_H") if name in ("hue", "hueOnly") else F.col("H")
    s = F.col("m_S") if name in ("hue", "saturationOnly") else F.col("S")
    df = df.withColumns(dict(zip(("c_r", "c_g", "c_b"), hsl_to_rgb(h, s, F.col("L")), strict=True)))
    cand = tuple(F.col(f"c_{c}") for c in RGB)
    df = df.withColumn("step", luma(*own) - luma(*cand))
    return put(df, tuple(byte(c + F.col("step")) for c in cand)).drop("H", "S", "L", "m_H", "m_S", "m_L", "c_r", "c_g", "c_b", "step")


def variant(px: DataFrame, name: str) -> DataFrame:
    """What a preset looks at: luma levelled, pure hue, saturation as grey, or luma stretched to its range over opaque pixels."""
    own = tuple(map(F.col, RGB))
    y = luma(*own)
    if name == "color":
        return px
    if name == "hue":
        return px.withColumn("y", num(128) - y).withColumns({c: byte(F.col(c) + F.col("y")) for c in RGB}).drop("y")
    if name == "contrast":
        ends = px.agg(F.coalesce(F.min(F.when(F.col("a") >= 128, y)), num(255)).alias("lo"), F.coalesce(F.max(F.when(F.col("a") >= 128, y)), num(0)).alias("hi"))
        v = byte((y - F.col("lo")) / F.greatest(num(1), F.col("hi") - F.col("lo")) * num(255))
        return px.crossJoin(F.broadcast(ends)).withColumn("v", v).withColumns({c: F.col("v") for c in RGB}).drop("v", "lo", "hi")
    df = _hsl(px, "")
    if name == "hueOnly":
        return df.withColumns(dict(zip(RGB, hsl_to_rgb(F.col("H"), num(1), num(0.5)), strict=True))).drop("H", "S", "L")
    return df.withColumn("v", byte(F.col("S") * num(255))).withColumns({c: F.col("v") for c in RGB}).drop("v", "H", "S", "L")


def toward_original(orig: Column, new: Column, weight: Column) -> Column:
    """Preview blend of lookup tables, rounded."""
    return F.when(weight >= num(0.999), new).when(weight <= num(0.001), orig).otherwise(half_up(orig + (new - orig) * weight))


def overlay(c: Column, tint: int, weight: Column) -> Column:
    """Red wash where the mask is weak."""
    wash = num(0.6) * (num(1) - weight)
    return F.when(wash < num(0.01), c).otherwise(half_up(c + (num(tint) - c) * wash))


TINT = (255, 40, 40)


def lut_grid(curves: DataFrame, size: int = 33, name: str = "color", strength: float = 1.0) -> DataFrame:
    """ri, gi, bi, r, g, b of all nodes. size**3 rows, made on the executors from three ranges."""
    spark = curves.sparkSession
    axis = lambda c: spark.range(size).select(F.col("id").cast("int").alias(f"{c}i"), half_up(F.col("id") / num(size - 1) * num(255)).alias(c))
    cells = axis("r").crossJoin(F.broadcast(axis("g"))).crossJoin(F.broadcast(axis("b")))
    used = curves.select(*[C.toward_identity(F.col(c), strength).alias(c) for c in RGB])
    if name == "contrast":
        used = used.select(C.average(*map(F.col, RGB)).alias("r")).select("r", F.col("r").alias("g"), F.col("r").alias("b"))
    return preset(mapped(cells, used), name).select("ri", "gi", "bi", *RGB)


def lut_row(grid: DataFrame) -> DataFrame:
    """The grid as one row of an array, red fastest. Its size is fixed by the grid's size alone (at most 65**3 nodes)."""
    return grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("bi", "gi", "ri", *RGB))), lambda x: F.struct(*[x[c].alias(c) for c in RGB])).alias("nodes"))


def apply_lut(px: DataFrame, grid: DataFrame, size: int = 33) -> DataFrame:
    """Trilinear lookup."""
    df = px.crossJoin(F.broadcast(lut_row(grid)))
    df = df.withColumns({f"p_{c}": F.col(c) * num((size - 1) / 255) for c in RGB})
    df = df.withColumns({f"i_{c}": F.least(F.lit(size - 1), F.floor(f"p_{c}").cast("int")) for c in RGB})
    df = df.withColumns({f"j_{c}": F.least(F.lit(size - 1), F.col(f"i_{c}") + 1) for c in RGB} | {f"f_{c}": F.col(f"p_{c}") - F.col(f"i_{c}") for c in RGB})
    corners = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    pick = lambda c, hi: F.col(f"{'j' if hi else 'i'}_{c}")
    share = lambda c, hi: F.col(f"f_{c}") if hi else num(1) - F.col(f"f_{c}")
    df = df.withColumns({f"n{x}{y}{z}": F.element_at("nodes", (pick("b", z) * size + pick("g", y)) * size + pick("r", x) + 1) for x, y, z in corners})
    df = df.withColumns({f"w{x}{y}{z}": share("r", x) * share("g", y) * share("b", z) for x, y, z in corners}).drop("nodes")

    def mixed(c: str) -> Column:
        total = None
        for x, y, z in corners:
            part = F.col(f"n{x}{y}{z}")[c] * F.col(f"w{x}{y}{z}")
            total = part if total is None else total + part
        return byte(total)

    return df.select(*[mixed(c).alias(c) if c in RGB else F.col(c) for c in px.columns])


def cube_lines(grid: DataFrame, size: int, name: str, title: str) -> DataFrame:
    """line_no, line of a .cube text: a header and one line per node, red fastest."""
    spark = grid.sparkSession
    header = [f"# {title} LUT — preset: {LABELS[name]}", f'TITLE "{title} {name}"', f"LUT_3D_SIZE {size}", "DOMAIN_MIN 0.0 0.0 0.0", "DOMAIN_MAX 1.0 1.0 1.0", ""]
    head = spark.createDataFrame(list(enumerate(header)), "line_no long, line string")
    no = (F.lit(len(header)) + (F.col("bi") * size + F.col("gi")) * size + F.col("ri")).cast("bigint")
    body = grid.select(no.alias("line_no"), F.format_string("%.6f %.6f %.6f", *[F.col(c) / num(255) for c in RGB]).alias("line"))
    return head.unionByName(body)


def icc_clut(grid: DataFrame, size: int) -> DataFrame:
    """Node number with blue fastest, and the node as big-endian 16-bit hex."""
    at = ((F.col("ri") * size + F.col("gi")) * size + F.col("bi")).cast("bigint")
    return grid.select(at.alias("node"), F.concat(*[F.lpad(F.hex(F.col(c) * 257), 4, "0") for c in RGB]).alias("hex"))
