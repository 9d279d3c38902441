"""Queries of histograms, fits and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.color import num
from tessera.operators import curves as C
from tessera.operators import dist as D
from tessera.sources.fixtures import table
from tessera.sources.fixtures import source_pixels as src
from tessera.sources.fixtures import target_pixels as tgt
from tessera.sources.shared import spread

from .sqltext import AXIS, BOTH, CHS, FITTED, SRC, TGT, byte, cdf_of, hist_of, lab, long_of, luma, wide

LONG = "SELECT ch, v, o \"out\" FROM curves"
ROWS = "SELECT v, r, g, b FROM "


def fitted(s, d):
    """The full fit as one row of arrays."""
    return D.arrays(D.fit_full(src(s, d), tgt(s, d)))


def on_curves(fn):
    """A query that changes each of the fitted curves alike."""
    return lambda s, d: C.rows(fitted(s, d).select(*[fn(F.col(c)).alias(c) for c in "rgb"]))


def shaped(s, d, process=True, dims=None, zones=None, knots=None):
    """Fit, process, dimensions, zones and envelope, as the panel chains them."""
    df = fitted(s, d)
    if process:
        df = df.select(*[C.process(F.col(c), 0.8, 3, 6).alias(c) for c in "rgb"])
    if dims:
        df = df.select(*[x.alias(c) for c, x in zip("rgb", C.dimensions(F.col("r"), F.col("g"), F.col("b"), dims), strict=True)])
    if zones or knots:
        df = df.select(*[C.zone_envelope(F.col(c), zones or C.ZONES, knots or C.ENVELOPE).alias(c) for c in "rgb"])
    return df


DIMS = C.Dimensions(value=120, chroma=130, hue_shift=25, contrast=120, neutralize=30, separation=90)
BANDS = (C.Zone(80, 42, 50, 10), C.Zone(60, 127, 40, -20), C.Zone(120, 212, 70, 0))
KNOTS = (C.Knot(0, 0.2, True), C.Knot(60, 1.5, True), C.Knot(127, 0.4, True), C.Knot(200, 1.0, False), C.Knot(255, 1.8, True))


def hist_channel(s, d):
    return D.histogram(src(s, d))


def cdf_channel(s, d):
    return D.cdf(D.histogram(src(s, d))).select("ch", "v", F.round("c", 9).alias("c"))


def hist_lab(s, d):
    return D.histogram(D.lab_bins(tgt(s, d)), ("lb", "ab", "bb"))


def percentile_bins(s, d):
    return D.percentiles(tgt(s, d)).select("ch", *[F.element_at("q", k + 1).alias(f"p{round(p * 100)}") for k, p in enumerate(D.PERCENTILES)])


def fit_query(mode, space="rgb"):
    return lambda s, d: D.fit(src(s, d), tgt(s, d), mode, space)


def _own(k, low, step, count):
    """A number of a row's own, by its key."""
    return (F.lit(low) + k * step % count).cast("double")


def zone_query(s, d):
    """Zones of every supplier's own, with amounts, anchors, falloffs and biases by its key."""
    k = F.col("s_suppkey")
    zones = F.array(*[F.struct(_own(k, 40, 13 + i, 90).alias("amount"), _own(k, 20 + 80 * i, 7, 60).alias("anchor"), _own(k, 10, 11 + i, 80).alias("falloff"), _own(k, -25, 17 + i, 50).alias("bias")) for i in range(3)])
    return spread(table(s, d, "supplier").select("s_suppkey"), k).select(k.alias("k"), F.posexplode(C.zone_weights_of(zones)).alias("v", "w")).select("k", "v", F.round("w", 9).alias("w"))


def envelope_query(s, d):
    """Five knots of every supplier's own; the last but one is a corner for every other supplier."""
    k = F.col("s_suppkey")
    knots = F.array(*[F.struct((_own(k, 64 * i, 7 + i, 40) if 0 < i < 4 else num(255 * (i > 0))).alias("position"), (_own(k, 0, 3 + 4 * i, 19) / num(7)).alias("weight"), (F.lit(True) if i != 3 else k % 2 == 0).alias("smooth")) for i in (3, 0, 1, 2, 4)])
    return spread(table(s, d, "supplier").select("s_suppkey"), k).select(k.alias("k"), F.posexplode(C.envelope_weights_of(knots)).alias("v", "w")).select("k", "v", F.round("w", 9).alias("w"))


def control_query(s, d):
    df = fitted(s, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), C.control_points(F.col(c)).alias("p")) for c in "rgb"])).alias("x"))
    return df.select("x.ch", F.posexplode("x.p").alias("i", "p")).select("ch", "i", "p.x", "p.y")


def average_query(s, d):
    return fitted(s, d).select(F.posexplode(C.average(F.col("r"), F.col("g"), F.col("b"))).alias("v", "out"))


def polyline(s, d):
    """The curve as drawn: every fourth value and the last."""
    return C.polyline(C.rows(fitted(s, d)), 4)


def luma_bars(s, d):
    """Bars of log counts over the highest."""
    return D.luma_bars(tgt(s, d)).select("l", F.round("h", 6).alias("h"))


def _zone_sql(name: str, zones=BANDS) -> str:
    import math

    bells = [f"{math.exp(z.bias / 50)!r}*exp(-((v-{z.anchor})*(v-{z.anchor}))*{1 / (2 * (18 + z.falloff / 100 * 60) ** 2)!r})" for z in zones]
    bells = [x.replace("*1.0*", "*") for x in bells]
    top = " + ".join(f"{z.amount / 100!r}*CAST({b} AS DOUBLE)" for z, b in zip(zones, bells, strict=True))
    return f"{name} AS (SELECT v, CAST({top} AS DOUBLE)/CAST({' + '.join(bells)} AS DOUBLE) w FROM axis)"


#: Tangents by a recursive walk over the knots, then one Hermite or straight piece per value.
ENVELOPE_SQL = """knots(k, x, y, s) AS (VALUES (0, 0e0, 2e-1, true), (1, 60e0, 15e-1, true), (2, 127e0, 4e-1, true), (3, 200e0, 1e0, false), (4, 255e0, 18e-1, true)),
seg AS (SELECT a.k, a.x xa, b.x xb, a.y ya, b.y yb, a.s AND b.s s, (b.y-a.y)/(b.x-a.x) d FROM knots a JOIN knots b ON b.k=a.k+1),
raw AS (SELECT k.k, CASE WHEN p.k IS NULL THEN n.d WHEN n.k IS NULL THEN p.d WHEN p.d*n.d <= 0 THEN 0e0 ELSE (p.d+n.d)/2e0 END m FROM knots k LEFT JOIN seg p ON p.k=k.k-1 LEFT JOIN seg n ON n.k=k.k),
walk(k, m, nxt) AS (
 SELECT 0, f0, f1 FROM (SELECT CASE WHEN d=0 THEN 0 WHEN sq>9 THEN 3e0/sqrt(sq)*a.m ELSE a.m END f0, CASE WHEN d=0 THEN 0 WHEN sq>9 THEN 3e0/sqrt(sq)*b.m ELSE b.m END f1
  FROM (SELECT * FROM raw WHERE k=0) a, (SELECT * FROM raw WHERE k=1) b, (SELECT d FROM seg WHERE k=0), LATERAL (SELECT CASE WHEN d=0 THEN 0 ELSE pow(a.m/d,2)+pow(b.m/d,2) END sq))
 UNION ALL
 SELECT w.k+1, CASE WHEN d=0 THEN 0 WHEN sq>9 THEN 3e0/sqrt(sq)*w.nxt ELSE w.nxt END, CASE WHEN d=0 THEN 0 WHEN sq>9 THEN 3e0/sqrt(sq)*r.m ELSE r.m END
  FROM walk w JOIN seg ON seg.k=w.k+1 JOIN raw r ON r.k=w.k+2, LATERAL (SELECT CASE WHEN d=0 THEN 0 ELSE pow(w.nxt/d,2)+pow(r.m/d,2) END sq)),
ends AS (SELECT seg.*, w.m ma, coalesce(w2.m, w.nxt) mb FROM seg JOIN walk w ON w.k=seg.k LEFT JOIN walk w2 ON w2.k=seg.k+1),
pick AS (SELECT v, min(k) k FROM axis JOIN seg ON v <= xb GROUP BY v),
env AS (SELECT v, CASE WHEN v <= 0 THEN 2e-1 WHEN v >= 255 THEN 18e-1 ELSE greatest(0e0, CASE WHEN s THEN (2*t*t*t-3*t*t+1)*ya + (t*t*t-2*t*t+t)*h*ma + (3*t*t-2*t*t*t)*yb + (t*t*t-t*t)*h*mb ELSE ya+(yb-ya)*t END) END w
 FROM (SELECT v, e.*, xb-xa h, (v-xa)/(xb-xa) t FROM pick JOIN ends e USING (k)))"""


def _many(sql: str) -> str:
    """The envelope's SQL for knots of many owners: every step also goes by owner o."""
    rest = sql[sql.index("seg AS") :]
    for a, b in (
        ("SELECT a.k, a.x xa", "SELECT a.o, a.k, a.x xa"),
        ("ON b.k=a.k+1)", "ON b.o=a.o AND b.k=a.k+1)"),
        ("raw AS (SELECT k.k,", "raw AS (SELECT k.o, k.k,"),
        ("ON p.k=k.k-1", "ON p.o=k.o AND p.k=k.k-1"),
        ("ON n.k=k.k)", "ON n.o=k.o AND n.k=k.k)"),
        ("walk(k, m, nxt)", "walk(o, k, m, nxt)"),
        ("SELECT 0, f0, f1 FROM (SELECT CASE", "SELECT o, 0, f0, f1 FROM (SELECT a.o, CASE"),
        ("(SELECT * FROM raw WHERE k=0) a, (SELECT * FROM raw WHERE k=1) b, (SELECT d FROM seg WHERE k=0)", "(SELECT * FROM raw WHERE k=0) a JOIN (SELECT * FROM raw WHERE k=1) b USING (o) JOIN (SELECT o, d FROM seg WHERE k=0) USING (o)"),
        ("SELECT w.k+1, CASE", "SELECT w.o, w.k+1, CASE"),
        ("ON seg.k=w.k+1 JOIN raw r ON r.k=w.k+2", "ON seg.o=w.o AND seg.k=w.k+1 JOIN raw r ON r.o=w.o AND r.k=w.k+2"),
        ("ON w.k=seg.k LEFT JOIN walk w2 ON w2.k=seg.k+1", "ON w.o=seg.o AND w.k=seg.k LEFT JOIN walk w2 ON w2.o=seg.o AND w2.k=seg.k+1"),
        ("pick AS (SELECT v, min(k) k FROM axis JOIN seg ON v <= xb GROUP BY v)", "pick AS (SELECT o, v, min(k) k FROM axis JOIN seg ON v <= xb GROUP BY o, v)"),
        ("env AS (SELECT v, CASE WHEN v <= 0 THEN 2e-1 WHEN v >= 255 THEN 18e-1 ELSE", "env AS (SELECT o, v, CASE WHEN v <= 0 THEN ya WHEN v >= 255 THEN yb ELSE"),
        ("pick JOIN ends e USING (k)", "pick JOIN ends e USING (o, k)"),
        ("(SELECT v, e.*,", "(SELECT v, e.* EXCLUDE (k),"),
    ):
        assert a in rest, a
        rest = rest.replace(a, b)
    knots = ", ".join(f"({i}, {'s_suppkey*%d %% 40 + %d' % (7 + i, 64 * i) if 0 < i < 4 else 255 * (i > 0)}, s_suppkey*{3 + 4 * i} % 19, {'s_suppkey % 2 = 0' if i == 3 else 'true'})" for i in range(5))
    return f"knots AS (SELECT s_suppkey o, k, CAST(x AS DOUBLE) x, y/7e0 y, s FROM supplier, LATERAL (VALUES {knots}) t(k, x, y, s)), {rest}"


ENVELOPES_SQL = _many(ENVELOPE_SQL)


def _mono(rel: str, out: str) -> str:
    return f"{out} AS (SELECT v, " + ", ".join(f"max({c}) OVER (ORDER BY v) {c}" for c in "rgb") + f" FROM {rel})"


def _smooth(rel: str, out: str, r: int) -> str:
    cols = ", ".join(f"CAST(floor(sum(w.{c})/{2 * r + 1}e0 + 5e-1) AS INT) {c}" for c in "rgb")
    return f"{out} AS (SELECT a.v, {cols} FROM axis a CROSS JOIN (SELECT range - {r} k FROM range({2 * r + 1})) JOIN {rel} w ON w.v = CASE WHEN a.v+k < 0 THEN -(a.v+k) WHEN a.v+k > 255 THEN 510-(a.v+k) ELSE a.v+k END GROUP BY a.v)"


def _blend(rel: str, out: str, a: str) -> str:
    return f"{out} AS (SELECT v, " + ", ".join(f"CAST(floor(v + ({c}-v)*{a} + 5e-1) AS INT) {c}" for c in "rgb") + f" FROM {rel})"


def _cap(rel: str, out: str, ratio: str) -> str:
    up = ", ".join(byte(f"u.{c} + {ratio}*tanh((w.{c}-u.{c})/{ratio})") for c in "rgb")
    return f"""{out}_up(v, r, g, b) AS (SELECT v, r, g, b FROM {rel} WHERE v=0 UNION ALL SELECT w.v, {up} FROM {out}_up u JOIN {rel} w ON w.v=u.v+1),
{out}(v, r, g, b) AS (SELECT v, r, g, b FROM {out}_up WHERE v=255 UNION ALL SELECT w.v, {up} FROM {out} u JOIN {out}_up w ON w.v=u.v-1)"""


def _dims(rel: str, out: str) -> str:
    c = []
    for x, y, z in ("rgb", "gbr", "brg"):
        d = {k: f"(({k}0-m)*13e-1)" for k in "rgb"}
        part = f"({d[x]}*cos(radians(25e0)) + ({d[y]}-{d[z]})/sqrt(3e0)*sin(radians(25e0)) + (({d['r']}+{d['g']}+{d['b']})/3e0)*(1-cos(radians(25e0))))"
        x1 = f"(v + (m-v)*12e-1 + {part})"
        x2 = f"({x1} + (v-{x1})*(3e-1*pow((v-1275e-1)/1275e-1, 2)))"
        x3 = f"(1275e-1 + ({x2}-1275e-1)*9e-1)"
        t = f"((greatest(0, least(255, {x3}))/255e0 - 5e-1)*2)"
        c.append(f"{byte(f'(5e-1 + (CASE WHEN {t} < 0 THEN -1 ELSE 1 END)*pow(abs({t}), 100e0/120)*5e-1)*255')} {x}")
    return f"{out}_raw AS (SELECT v, {', '.join(c)} FROM (SELECT v, r r0, g g0, b b0, (r+g+b)/3e0 m FROM {rel})), {_mono(out + '_raw', out)}"


PROCESSED = ",\n".join([_cap("wide", "capped", "6e0"), _blend("capped", "blended", "8e-1"), _smooth("blended", "smoothed", 3), _mono("smoothed", "processed")])
ZONED = ",\n".join([_zone_sql("zw"), ENVELOPE_SQL, "ze_raw AS (SELECT c.v, " + ", ".join(byte(f"c.v + (c.{c}-c.v)*(zw.w*env.w)") + f" {c}" for c in "rgb") + " FROM wide c JOIN zw USING (v) JOIN env USING (v))", _mono("ze_raw", "zoned")])
R = "WITH RECURSIVE "
_P = "CAST(CASE WHEN max(tot)=0 THEN 128 ELSE coalesce(min(CASE WHEN cum >= tot*{0} THEN v END), 255) END AS INT)"
_QS = ", ".join(f"{_P.format(p)} {n}" for p, n in (("5e-2", "p5"), ("25e-2", "p25"), ("5e-1", "p50"), ("75e-2", "p75"), ("95e-2", "p95")))
_LABS = f"""ls AS {lab("(SELECT * FROM src WHERE a >= 128)", "r, g, b")}, lt AS {lab("(SELECT * FROM tgt WHERE a >= 128)", "r, g, b")}"""
_LB = ", ".join([byte("l_*255e-2") + " lb", byte("a_+128") + " ab", byte("b_+128") + " bb"])


def _lablong(name: str, rel: str) -> str:
    return f"{name} AS (SELECT 'lb' ch, lb v FROM {rel} UNION ALL SELECT 'ab', ab FROM {rel} UNION ALL SELECT 'bb', bb FROM {rel})"


_UNLAB = """SELECT r, g, b, {0} FROM (SELECT *, (l2+16)/116e0 fy FROM m), LATERAL (SELECT a2/500e0+fy fx, fy-b2/200e0 fz),
 LATERAL (SELECT (CASE WHEN fx*fx*fx > 8856e-6 THEN fx*fx*fx ELSE (fx-16e0/116)/7787e-3 END)*95047e-5 x, CASE WHEN fy*fy*fy > 8856e-6 THEN fy*fy*fy ELSE (fy-16e0/116)/7787e-3 END y,
 (CASE WHEN fz*fz*fz > 8856e-6 THEN fz*fz*fz ELSE (fz-16e0/116)/7787e-3 END)*108883e-5 z),
 LATERAL (SELECT 32404542e-7*x - 15371385e-7*y - 4985314e-7*z lr, -9692660e-7*x + 18760108e-7*y + 415560e-7*z lg, 556434e-7*x - 2040259e-7*y + 10572252e-7*z lb2)"""
_GAM = lambda c: byte(f"(CASE WHEN {c} <= 31308e-7 THEN 1292e-2*{c} ELSE 1055e-3*pow(greatest(0e0, {c}), 1e0/24e-1) - 55e-3 END)*255")
UNLAB = _UNLAB.format(f"{_GAM('lr')} o_r, {_GAM('lg')} o_g, {_GAM('lb2')} o_b")
FIT_LAB_SQL = f"""WITH {SRC}, {TGT}, {AXIS}, {_LABS}, chs AS (SELECT unnest(['lb','ab','bb']) ch),
bs AS (SELECT {_LB} FROM ls), bt AS (SELECT r, g, b, {_LB} FROM lt), {_lablong("sl", "bs")}, {_lablong("tl", "bt")},
{hist_of("sh", "sl")}, {hist_of("th", "tl")}, {cdf_of("sc", "sh")}, {cdf_of("tc", "th")},
cu AS (SELECT t.ch, t.v, coalesce(min(s.v), 255) o FROM tc t LEFT JOIN sc s ON s.ch=t.ch AND s.c >= t.c GROUP BY 1,2),
m AS (SELECT r, g, b, cl.o/255e-2 l2, ca.o-128 a2, cb.o-128 b2 FROM bt JOIN cu cl ON cl.ch='lb' AND cl.v=lb JOIN cu ca ON ca.ch='ab' AND ca.v=ab JOIN cu cb ON cb.ch='bb' AND cb.v=bb),
o AS ({UNLAB}), long AS (SELECT 'r' ch, r v, o_r o FROM o UNION ALL SELECT 'g', g, o_g FROM o UNION ALL SELECT 'b', b, o_b FROM o),
mean AS (SELECT c.ch, x.v, avg(l.o) m FROM (SELECT unnest(['r','g','b']) ch) c CROSS JOIN axis x LEFT JOIN long l ON l.ch=c.ch AND l.v=x.v GROUP BY 1,2),
f AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY ch ORDER BY v ROWS UNBOUNDED PRECEDING) held, min(v) FILTER (m IS NOT NULL) OVER (PARTITION BY ch) f0 FROM mean),
g AS (SELECT f.*, {byte("s.m")} st FROM f LEFT JOIN mean s ON s.ch=f.ch AND s.v=f.f0),
h AS (SELECT ch, v, CASE WHEN f0 IS NULL THEN v WHEN v < f0 THEN CAST(floor(v/CAST(f0 AS DOUBLE)*st + 5e-1) AS INT) ELSE {byte("held")} END raw FROM g)
SELECT ch, v, max(raw) OVER (PARTITION BY ch ORDER BY v) "out" FROM h"""
LUMA_SQL = f"""WITH {TGT}, {AXIS} SELECT x.v l, count(t.l) n, CAST(coalesce(sum(r),0) AS BIGINT) sum_r, CAST(coalesce(sum(g),0) AS BIGINT) sum_g, CAST(coalesce(sum(b),0) AS BIGINT) sum_b
FROM axis x LEFT JOIN (SELECT *, CAST(floor({luma()} + 5e-1) AS INT) l FROM tgt WHERE a >= 8) t ON t.l=x.v GROUP BY 1"""

QUERIES = {
    "hist_channel": hist_channel,
    "cdf_channel": cdf_channel,
    "hist_lab": hist_lab,
    "hist_specify": fit_query("full"),
    "fit_full_rgb": lambda s, d: C.rows(fitted(s, d)),
    "fit_mean": fit_query("mean"),
    "fit_median": fit_query("median"),
    "fit_percentiles": fit_query("percentiles"),
    "fit_lab": fit_query("full", "lab"),
    "percentile_bins": percentile_bins,
    "luma_bins": lambda s, d: D.luma_bins(tgt(s, d)),
    "luma_range": lambda s, d: D.luma_range(D.luma_bins(tgt(s, d))),
    "luma_bars": luma_bars,
    "luma_polyline": lambda s, d: C.polyline(luma_bars(s, d).withColumnRenamed("l", "v"), 4),
    "curve_blend": on_curves(lambda c: C.blend(c, 0.65)),
    "curve_strength": on_curves(lambda c: C.toward_identity(c, 0.4)),
    "curve_monotonic": lambda s, d: C.rows(fitted(s, d).select(*[C.monotonic(F.reverse(c)).alias(c) for c in "rgb"])),
    "curve_smooth": on_curves(lambda c: C.smooth(c, 9)),
    "curve_cap": on_curves(lambda c: C.cap(c, 2.5)),
    "curve_process": on_curves(lambda c: C.process(c, 0.8, 3, 6)),
    "curve_dimensions": lambda s, d: C.rows(shaped(s, d, False, DIMS)),
    "curve_average": average_query,
    "curve_polyline": polyline,
    "zone_weights": zone_query,
    "zone_apply": lambda s, d: C.rows(fitted(s, d).select(*[C.monotonic(C.apply_weights(F.col(c), C.zone_weights(BANDS))).alias(c) for c in "rgb"])),
    "envelope_weights": envelope_query,
    "envelope_polyline": lambda s, d: C.polyline(envelope_query(s, d), 2),
    "zone_envelope": lambda s, d: C.rows(shaped(s, d, False, None, BANDS, KNOTS)),
    "control_points": control_query,
}
SQL = {
    "hist_channel": f"WITH {SRC}, {AXIS}, {CHS}, {long_of('sl', 'src')}, {hist_of('sh', 'sl')} SELECT ch, v, n FROM sh",
    "cdf_channel": f"WITH {SRC}, {AXIS}, {CHS}, {long_of('sl', 'src')}, {hist_of('sh', 'sl')}, {cdf_of('sc', 'sh')} SELECT ch, v, round(c, 9) c FROM sc",
    "hist_lab": f"WITH {TGT}, {AXIS}, chs AS (SELECT unnest(['lb','ab','bb']) ch), lt AS {lab('(SELECT * FROM tgt WHERE a >= 128)', 'a')}, bt AS (SELECT {_LB} FROM lt), {_lablong('tl', 'bt')}, {hist_of('th', 'tl')} SELECT ch, v, n FROM th",
    "hist_specify": f"WITH {FITTED} {LONG}",
    "fit_full_rgb": f"WITH {FITTED} {ROWS} wide",
    "fit_mean": f"""WITH {BOTH}, d AS (SELECT c.ch, coalesce(s.m - t.m, 0) d FROM chs c LEFT JOIN (SELECT ch, avg(v) m FROM sl GROUP BY 1) s USING (ch) LEFT JOIN (SELECT ch, avg(v) m FROM tl GROUP BY 1) t USING (ch))
SELECT ch, v, {byte('v + d')} "out" FROM d CROSS JOIN axis""",
    "fit_median": f"""WITH {BOTH}, d AS (SELECT s.ch, s.p - t.p d FROM (SELECT ch, {_P.format('5e-1')} p FROM sc GROUP BY 1) s JOIN (SELECT ch, {_P.format('5e-1')} p FROM tc GROUP BY 1) t USING (ch))
SELECT ch, v, {byte('v + d')} "out" FROM d CROSS JOIN axis""",
    "fit_percentiles": f"""WITH {BOTH}, s AS (SELECT ch, {_QS} FROM sc GROUP BY 1), t AS (SELECT ch, {_QS} FROM tc GROUP BY 1),
x AS (SELECT ch, 0 i, 0 xv, 0 yv FROM chs UNION ALL SELECT ch, 1, t.p5, s.p5 FROM s JOIN t USING (ch) UNION ALL SELECT ch, 2, t.p25, s.p25 FROM s JOIN t USING (ch) UNION ALL SELECT ch, 3, t.p50, s.p50 FROM s JOIN t USING (ch)
 UNION ALL SELECT ch, 4, t.p75, s.p75 FROM s JOIN t USING (ch) UNION ALL SELECT ch, 5, t.p95, s.p95 FROM s JOIN t USING (ch) UNION ALL SELECT ch, 6, 255, 255 FROM chs),
seg AS (SELECT a.ch, a.i, a.xv xa, b.xv xb, a.yv ya, b.yv yb FROM x a JOIN x b ON b.ch=a.ch AND b.i=a.i+1),
pick AS (SELECT ch, v, coalesce(min(i) FILTER (v <= xb), 5) i FROM seg CROSS JOIN axis GROUP BY 1, 2)
SELECT ch, v, {byte('ya + (yb-ya)*((v-xa)/CAST(CASE WHEN xb=xa THEN 1 ELSE xb-xa END AS DOUBLE))')} "out" FROM pick JOIN seg USING (ch, i)""",
    "fit_lab": FIT_LAB_SQL,
    "percentile_bins": f"WITH {BOTH} SELECT ch, {_QS} FROM tc GROUP BY 1",
    "luma_bins": LUMA_SQL,
    "luma_range": f"WITH b AS ({LUMA_SQL}), t AS (SELECT max(n) top FROM b), f AS (SELECT min(l) lo, max(l) hi FROM b, t WHERE n > top*5e-3) SELECT coalesce(lo, 0) range_start, greatest(coalesce(lo, 0)+1, coalesce(hi, 255)) range_end FROM f",
    "luma_polyline": f"WITH b AS ({LUMA_SQL}), m AS (SELECT max(ln(1+n)) top FROM b) SELECT l v, round(ln(1+n)/CASE WHEN top > 0 THEN top ELSE 1 END, 6) h FROM b, m WHERE l % 4 = 0 OR l = 255",
    "luma_bars": f"WITH b AS ({LUMA_SQL}), m AS (SELECT max(ln(1+n)) top FROM b) SELECT l, round(ln(1+n)/CASE WHEN top > 0 THEN top ELSE 1 END, 6) h FROM b, m",
    "curve_blend": f"WITH {FITTED}, {_blend('wide', 'x', '65e-2')} {ROWS} x",
    "curve_strength": f"WITH {FITTED}, {_blend('wide', 'x', '4e-1')} {ROWS} x",
    "curve_monotonic": f"WITH {FITTED}, rev AS (SELECT CAST(255-v AS INT) v, r, g, b FROM wide), {_mono('rev', 'x')} {ROWS} x",
    "curve_smooth": f"WITH {FITTED}, {_smooth('wide', 'x', 9)} {ROWS} x",
    "curve_cap": f"{R}{FITTED}, {_cap('wide', 'x', '25e-1')} {ROWS} x",
    "curve_process": f"{R}{FITTED}, {PROCESSED} {ROWS} processed",
    "curve_dimensions": f"WITH {FITTED}, {_dims('wide', 'x')} {ROWS} x",
    "curve_average": f"WITH {FITTED} SELECT v, CAST(floor((r+g+b)/3e0 + 5e-1) AS INT) \"out\" FROM wide",
    "curve_polyline": f"WITH {FITTED} {ROWS} wide WHERE v % 4 = 0 OR v = 255",
    "zone_weights": f"""WITH {AXIS}, zs AS (SELECT s_suppkey k, i, CAST(40 + s_suppkey*(13+i) % 90 AS DOUBLE)/100e0 a, CAST(20 + 80*i + s_suppkey*7 % 60 AS DOUBLE) c, 18 + CAST(10 + s_suppkey*(11+i) % 80 AS DOUBLE)/100e0*60 sg, CAST(-25 + s_suppkey*(17+i) % 50 AS DOUBLE) bi FROM supplier, (SELECT unnest([0, 1, 2]) i)),
be AS (SELECT k, v, a, exp(bi/50e0)*exp(-((v-c)*(v-c))/(2*sg*sg)) bell FROM zs, axis) SELECT k, v, round(sum(a*bell)/CASE WHEN sum(bell) = 0 THEN 1 ELSE sum(bell) END, 9) w FROM be GROUP BY k, v""",
    "zone_apply": f"WITH {FITTED}, {_zone_sql('zw')}, raw AS (SELECT c.v, {', '.join(byte(f'c.v + (c.{c}-c.v)*zw.w') + ' ' + c for c in 'rgb')} FROM wide c JOIN zw USING (v)), {_mono('raw', 'x')} {ROWS} x",
    "envelope_weights": f"{R}{AXIS}, {ENVELOPES_SQL} SELECT o k, v, round(w, 9) w FROM env",
    "envelope_polyline": f"{R}{AXIS}, {ENVELOPES_SQL} SELECT o k, v, round(w, 9) w FROM env WHERE v % 2 = 0 OR v = 255",
    "zone_envelope": f"{R}{FITTED}, {ZONED} {ROWS} zoned",
    "control_points": f"WITH {FITTED}, p AS (SELECT CAST(range AS INT) i, CAST(floor(range/11e0*255 + 5e-1) AS INT) x FROM range(12)) SELECT ch, i, x, o y FROM p JOIN curves ON v=x",
}
