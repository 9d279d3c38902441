"""Queries of scalar colour functions, pixel filters, blends and lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import color as K
from tessera.functions.color import num
from tessera.operators import dist as D
from tessera.operators import pixels as P
from tessera.sources.fixtures import source_pixels as src
from tessera.sources.fixtures import target_pixels as tgt

from .fits import PROCESSED, R, fitted, shaped
from .sqltext import FITTED, SRC, TGT, byte, hsl, lab, luma, unhsl

OUT = ("px_id", "r", "g", "b", "a")
SIZE = 17


def processed(s, d):
    return shaped(s, d)


def weight(df):
    """A weight from the pixel number, some below 0 and above 1."""
    return df.withColumn("w", ((F.col("px_id") * 7) % 300 - 20) / num(256))


W_SQL = "(((px_id*7) % 300 - 20)/256e0)"


def apply_curves(s, d):
    return P.apply_curves(tgt(s, d), fitted(s, d)).select(*OUT)


def apply_weighted(s, d):
    return P.apply_weighted(weight(tgt(s, d)), fitted(s, d), "w").select(*OUT)


def preset_query(name):
    return lambda s, d: P.preset(P.mapped(tgt(s, d), fitted(s, d)), name).select(*OUT)


def variant_query(name):
    return lambda s, d: P.variant(tgt(s, d), name).select(*OUT)


def lut_weighted(s, d):
    df = P.mapped(weight(tgt(s, d)), fitted(s, d))
    return P.put(df, tuple(P.toward_original(F.col(c), F.col(f"m_{c}"), F.greatest(num(0), F.least(num(1), F.col("w")))) for c in P.RGB)).select(*OUT)


def mask_overlay(s, d):
    w = F.greatest(num(0), F.least(num(1), F.col("w")))
    return weight(tgt(s, d)).withColumns({c: P.overlay(F.col(c), t, w) for c, t in zip(P.RGB, P.TINT, strict=True)}).select(*OUT)


def rgb_to_lab(s, d):
    l, a, b = (F.col(f"lab_{c}") for c in "lab")  # noqa: E741
    return K.with_lab(tgt(s, d)).select("px_id", *[F.round(c, 6).alias(n) for c, n in ((l, "lab_l"), (a, "lab_a"), (b, "lab_b"))])


def lab_to_rgb(s, d):
    px = tgt(s, d).select("px_id", (F.col("r") / num(2.55)).alias("l"), (F.col("g") - num(128)).alias("a"), (F.col("b") - num(128)).alias("bb"))
    return K.with_rgb(px, F.col("l"), F.col("a"), F.col("bb")).select("px_id", "r", "g", "b")


def rgb_to_hsl(s, d):
    h, sat, light = K.rgb_to_hsl(*map(F.col, "rgb"))
    return tgt(s, d).select("px_id", F.round(h, 9).alias("h"), F.round(sat, 9).alias("s"), F.round(light, 9).alias("l"))


def hsl_to_rgb(s, d):
    px = tgt(s, d).select("px_id", (F.col("r") / num(256)).alias("h"), (F.col("g") / num(255)).alias("s"), (F.col("b") / num(255)).alias("l"))
    return px.select("px_id", *[c.alias(n) for c, n in zip(K.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l")), "rgb", strict=True)])


def lut_query(name):
    return lambda s, d: P.lut_grid(processed(s, d), SIZE, name, 0.7)


def lut_trilinear(s, d):
    return P.apply_lut(tgt(s, d), P.lut_grid(fitted(s, d), SIZE), SIZE).select(*OUT)


def cube(s, d):
    return P.cube_lines(P.lut_grid(fitted(s, d), SIZE, "hue"), SIZE, "hue", "Tessera")


def clut(s, d):
    return P.icc_clut(P.lut_grid(fitted(s, d), SIZE), SIZE)


M = "m AS (SELECT t.*, cr.r mr, cg.g mg, cb.b mb FROM tgt t JOIN wide cr ON cr.v=t.r JOIN wide cg ON cg.v=t.g JOIN wide cb ON cb.v=t.b)"
O = "px_id, r, g, b, a"  # noqa: E741


def _blend(rel: str, h: str, s: str, keep: str) -> str:
    """Keep and the blended r, g, b from rel with r, g, b and mr, mg, mb."""
    k = f"{keep}, r, g, b, mr, mg, mb"
    own = hsl(rel, k, "", "o")
    both = hsl(f"(SELECT *, mr r_, mg g_, mb b_ FROM {own})", f"{k}, ho, so, lo", "_", "m")
    c = unhsl(h, s, "lo")
    return f"""SELECT {keep}, {byte('c0+st')} r, {byte('c1+st')} g, {byte('c2+st')} b FROM (SELECT *, {luma()} - (2126e-4*c0 + 7152e-4*c1 + 722e-4*c2) st FROM
 (SELECT *, {c[0]} c0, {c[1]} c1, {c[2]} c2 FROM {both}))"""


HS = {"hue": ("hm", "sm"), "hueOnly": ("hm", "so"), "saturationOnly": ("ho", "sm")}


def _preset(rel: str, name: str, keep: str) -> str:
    if name == "color":
        return f"SELECT {keep}, mr r, mg g, mb b FROM {rel}"
    if name == "contrast":
        step = f"((2126e-4*mr + 7152e-4*mg + 722e-4*mb) - (2126e-4*x.r + 7152e-4*x.g + 722e-4*x.b))"  # noqa: F541
        return f"SELECT {keep}, {', '.join(byte(f'x.{c} + {step}') + ' ' + c for c in 'rgb')} FROM {rel} x"
    return _blend(rel, *HS[name], keep)


def _grid(curves: str, name: str, size: int = SIZE) -> str:
    """CTEs that end in grid(ri, gi, bi, r, g, b)."""
    cv = curves
    pre = ""
    if name == "contrast":
        pre = f"av AS (SELECT v, CAST(floor((r+g+b)/3e0 + 5e-1) AS INT) r, CAST(floor((r+g+b)/3e0 + 5e-1) AS INT) g, CAST(floor((r+g+b)/3e0 + 5e-1) AS INT) b FROM {curves}), "
        cv = "av"
    ax = f"ax AS (SELECT CAST(range AS INT) i, CAST(floor(range/CAST({size - 1} AS DOUBLE)*255 + 5e-1) AS INT) n FROM range({size}))"
    return f"""{pre}{ax}, cell AS (SELECT x.i ri, y.i gi, z.i bi, x.n r, y.n g, z.n b, cr.r mr, cg.g mg, cb.b mb FROM ax x CROSS JOIN ax y CROSS JOIN ax z JOIN {cv} cr ON cr.v=x.n JOIN {cv} cg ON cg.v=y.n JOIN {cv} cb ON cb.v=z.n),
grid AS ({_preset('cell', name, 'ri, gi, bi')})"""


STRONG = "str AS (SELECT v, " + ", ".join(f"CAST(floor(v + ({c}-v)*7e-1 + 5e-1) AS INT) {c}" for c in "rgb") + " FROM processed)"
G = "ri, gi, bi, r, g, b"
TRI = f"""WITH {FITTED}, {_grid('wide', 'color')}, p AS (SELECT *, r*({SIZE - 1}/255e0) pr, g*({SIZE - 1}/255e0) pg, b*({SIZE - 1}/255e0) pb FROM tgt),
q AS (SELECT px_id, a, CAST(floor(pr) AS INT) ir, CAST(floor(pg) AS INT) ig, CAST(floor(pb) AS INT) ib, pr-floor(pr) fr, pg-floor(pg) fg, pb-floor(pb) fb FROM p),
k AS (SELECT unnest([0,1,0,1,0,1,0,1]) x, unnest([0,0,1,1,0,0,1,1]) y, unnest([0,0,0,0,1,1,1,1]) z),
w AS (SELECT q.px_id, q.a, least({SIZE - 1}, ir+x) ri, least({SIZE - 1}, ig+y) gi, least({SIZE - 1}, ib+z) bi, (CASE x WHEN 1 THEN fr ELSE 1-fr END)*(CASE y WHEN 1 THEN fg ELSE 1-fg END)*(CASE z WHEN 1 THEN fb ELSE 1-fb END) wt FROM q CROSS JOIN k)
SELECT px_id, {byte('round(sum(g.r*wt), 9)')} r, {byte('round(sum(g.g*wt), 9)')} g, {byte('round(sum(g.b*wt), 9)')} b, any_value(w.a) a FROM w JOIN grid g USING (ri, gi, bi) GROUP BY px_id"""

QUERIES = {
    "apply_curves": apply_curves,
    "apply_weighted": apply_weighted,
    **{f"preset_{k}": preset_query(v) for k, v in (("color_full", "color"), ("color", "hue"), ("hue", "hueOnly"), ("saturation", "saturationOnly"), ("contrast", "contrast"))},
    **{f"variant_{k}": variant_query(k) for k in ("hue", "hueOnly", "saturationOnly", "contrast")},
    "lut_weighted": lut_weighted,
    "mask_overlay": mask_overlay,
    "rgb_to_lab": rgb_to_lab,
    "lab_to_rgb": lab_to_rgb,
    "rgb_to_hsl": rgb_to_hsl,
    "hsl_to_rgb": hsl_to_rgb,
    "hash01": lambda s, d: tgt(s, d).select("px_id", K.hash01(F.col("px_id")).alias("u")),
    "scan_pixels": lambda s, d: tgt(s, d).filter(F.col("x").between(20, 70) & F.col("y").between(2, 6)).select("px_id", "x", "y", *P.RGB, F.coalesce("a", F.lit(255)).alias("a")),
    "filter_alpha": lambda s, d: tgt(s, d).filter("a >= 128").select(*OUT),
    "stride_sample": lambda s, d: tgt(s, d).filter("px_id % 4 = 0").filter("a >= 128").select(*OUT),
    "unpivot_channels": lambda s, d: D.channels(src(s, d)).groupBy("ch", "v").count().withColumnRenamed("count", "n"),
    "lut_grid": lut_query("color"),
    "lut_grid_contrast": lut_query("contrast"),
    "lut_grid_hue": lut_query("hueOnly"),
    "lut_trilinear": lut_trilinear,
    "cube_lines": cube,
    "icc_clut": clut,
}
L = f"(SELECT px_id, r/255e-2 l2, g-128e0 a2, b-128e0 b2, r, g, b FROM tgt)"  # noqa: F541
C = unhsl("h", "s", "l")
_CW = f"greatest(0e0, least(1e0, {W_SQL}))"
SQL = {
    "apply_curves": f"WITH {FITTED}, {M} SELECT px_id, mr r, mg g, mb b, a FROM m",
    "apply_weighted": f"WITH {FITTED}, {M}, n AS (SELECT *, CAST(floor({_CW}*256 + 5e-1) AS INT) wi FROM m) SELECT px_id, a, {', '.join(f'CASE wi WHEN 256 THEN m{c} WHEN 0 THEN n.{c} ELSE n.{c} + (((m{c}-n.{c})*wi) >> 8) END {c}' for c in 'rgb')} FROM n",
    **{f"preset_{k}": f"WITH {FITTED}, {M} SELECT {O} FROM ({_preset('m', v, 'px_id, a')})" for k, v in (("color_full", "color"), ("color", "hue"), ("hue", "hueOnly"), ("saturation", "saturationOnly"), ("contrast", "contrast"))},
    "variant_hue": f"WITH {TGT}, y AS (SELECT *, 128 - {luma()} st FROM tgt) SELECT px_id, {', '.join(byte(f'y.{c} + st') + ' ' + c for c in 'rgb')}, a FROM y",
    "variant_hueOnly": f"WITH {TGT}, y AS (SELECT px_id, a, h FROM {hsl('tgt', 'px_id, a', '', '')}) SELECT px_id, {', '.join(f'CAST({x} AS INT) {c}' for x, c in zip(unhsl('h', '1e0', '5e-1'), 'rgb', strict=True))}, a FROM y",
    "variant_saturationOnly": f"WITH {TGT}, y AS (SELECT px_id, a, {byte('s*255')} v FROM {hsl('tgt', 'px_id, a', '', '')}) SELECT px_id, v r, v g, v b, a FROM y",
    "variant_contrast": f"WITH {TGT}, e AS (SELECT coalesce(min({luma()}) FILTER (a >= 128), 255) lo, coalesce(max({luma()}) FILTER (a >= 128), 0) hi FROM tgt), y AS (SELECT px_id, a, {byte(f'({luma()} - lo)/greatest(1, hi-lo)*255')} v FROM tgt, e) SELECT px_id, v r, v g, v b, a FROM y",
    "lut_weighted": f"WITH {FITTED}, {M}, n AS (SELECT *, {_CW} w FROM m) SELECT px_id, a, {', '.join(f'CASE WHEN w >= 999e-3 THEN m{c} WHEN w <= 1e-3 THEN n.{c} ELSE CAST(floor(n.{c} + (m{c}-n.{c})*w + 5e-1) AS INT) END {c}' for c in 'rgb')} FROM n",
    "mask_overlay": f"WITH {TGT}, n AS (SELECT *, 6e-1*(1-{_CW}) w FROM tgt) SELECT px_id, a, {', '.join(f'CASE WHEN w < 1e-2 THEN n.{c} ELSE CAST(floor(n.{c} + ({t}-n.{c})*w + 5e-1) AS INT) END {c}' for c, t in zip('rgb', (255, 40, 40), strict=True))} FROM n",
    "rgb_to_lab": f"WITH {TGT} SELECT px_id, round(l_, 6) lab_l, round(a_, 6) lab_a, round(b_, 6) lab_b FROM {lab('tgt', 'px_id')}",
    "lab_to_rgb": "",
    "rgb_to_hsl": f"WITH {TGT} SELECT px_id, round(h, 9) h, round(s, 9) s, round(l, 9) l FROM {hsl('tgt', 'px_id', '', '')}",
    "hsl_to_rgb": f"WITH {TGT}, y AS (SELECT px_id, r/256e0 h, g/255e0 s, b/255e0 l FROM tgt) SELECT px_id, {', '.join(f'CAST({x} AS INT) {c}' for x, c in zip(C, 'rgb', strict=True))} FROM y",
    "hash01": f"WITH {TGT} SELECT px_id, (((px_id+1)*2654435761) % 4294967296)/4294967296e0 u FROM tgt",
    "scan_pixels": f"WITH {TGT} SELECT px_id, x, y, r, g, b, coalesce(a, 255) a FROM tgt WHERE x BETWEEN 20 AND 70 AND y BETWEEN 2 AND 6",
    "filter_alpha": f"WITH {TGT} SELECT {O} FROM tgt WHERE a >= 128",
    "stride_sample": f"WITH {TGT} SELECT {O} FROM tgt WHERE a >= 128 AND px_id % 4 = 0",
    "unpivot_channels": f"WITH {SRC} SELECT ch, v, count(*) n FROM (SELECT 'r' ch, r v FROM src UNION ALL SELECT 'g', g FROM src UNION ALL SELECT 'b', b FROM src) GROUP BY 1, 2",
    "lut_grid": f"{R}{FITTED}, {PROCESSED}, {STRONG}, {_grid('str', 'color')} SELECT {G} FROM grid",
    "lut_grid_contrast": f"{R}{FITTED}, {PROCESSED}, {STRONG}, {_grid('str', 'contrast')} SELECT {G} FROM grid",
    "lut_grid_hue": f"{R}{FITTED}, {PROCESSED}, {STRONG}, {_grid('str', 'hueOnly')} SELECT {G} FROM grid",
    "lut_trilinear": TRI,
    "cube_lines": f"""WITH {FITTED}, {_grid('wide', 'hue')} SELECT CAST(6 + (bi*{SIZE} + gi)*{SIZE} + ri AS BIGINT) line_no, format('{{:.6f}} {{:.6f}} {{:.6f}}', r/255e0, g/255e0, b/255e0) line FROM grid
UNION ALL SELECT * FROM (VALUES (0, '# Tessera LUT — preset: Color'), (1, 'TITLE "Tessera hue"'), (2, 'LUT_3D_SIZE {SIZE}'), (3, 'DOMAIN_MIN 0.0 0.0 0.0'), (4, 'DOMAIN_MAX 1.0 1.0 1.0'), (5, ''))""",
    "icc_clut": f"WITH {FITTED}, {_grid('wide', 'color')} SELECT CAST((ri*{SIZE} + gi)*{SIZE} + bi AS BIGINT) node, {' || '.join(f'''lpad(to_hex({c}*257), 4, '0')''' for c in 'rgb')} hex FROM grid",
}
from .fits import UNLAB  # noqa: E402

SQL["lab_to_rgb"] = f"WITH {TGT}, m AS (SELECT px_id r, r/255e-2 l2, g-128e0 a2, b-128e0 b2, 0 g, 0 b FROM tgt), o AS ({UNLAB}) SELECT r px_id, o_r r, o_g g, o_b b FROM o"
