"""Queries of palettes, masks and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.color import num
from tessera.operators import palette as A
from tessera.operators import pixels as P
from tessera.operators import raster as T
from tessera.sources.files import png_tiles
from tessera.sources.fixtures import CLUSTERS
from tessera.sources.fixtures import table
from tessera.sources.fixtures import target_pixels as tgt

from .fits import UNLAB, fitted
from .pixels import M, _preset
from .sqltext import FITTED, TGT, byte, lab, luma

LABS = [c[1:4] for c in CLUSTERS]
WEIGHTS = [c[4] for c in CLUSTERS]
SOFT = 30
RECIPE_PIXELS = 64


def swatches(s, d):
    """A palette of two to four swatches a customer, with prevalences and user weights; some have neither."""
    k, j = F.col("c_custkey").cast("long"), F.col("idx")
    df = table(s, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int") + 1)).alias("idx"))
    part = lambda p, q: ((k * p + j * q) % 256).cast("int")
    return df.select(k.alias("k"), "idx", part(37, 91).alias("r"), part(11, 57).alias("g"), part(5, 133).alias("b"), ((k + j * 3) % 5 / num(8)).alias("weight"), ((k * 7 + j * 5) % 4 / num(2)).alias("user"))


def distances(s, d):
    return A.with_distances(tgt(s, d), LABS)


def cluster_distances(s, d):
    return A.long_distances(distances(s, d)).select("px_id", "k", F.round("d", 6).alias("d"))


def nearest_cluster(s, d):
    near = (F.array_position("d", F.array_min("d")) - 1).cast("int")
    return A.with_distances(tgt(s, d).filter("a >= 128"), LABS).select("px_id", near.alias("k"))


def weights_query(softness):
    return lambda s, d: distances(s, d).select("px_id", F.round(A.effective_weight(WEIGHTS, softness), 6).alias("ew"))


def palette_mask(s, d):
    return distances(s, d).select("px_id", A.palette_mask(WEIGHTS).alias("hard"), A.palette_mask(WEIGHTS, SOFT).alias("soft"))


def weighted(s, d):
    return distances(s, d).withColumn("ew", F.round(A.effective_weight(WEIGHTS, SOFT), 9)).drop("d")


def kmeans(s, d):
    df = A.kmeans(tgt(s, d), 5)
    return df.select("ord", "r", "g", "b", F.round("weight", 9).alias("weight"), *[F.round(f"lab_{c}", 6).alias(f"lab_{c}") for c in "lab"])


def shares(s, d):
    return A.bar(swatches(s, d), "k").select("k", "idx", "ord", *[F.round(c, 9).alias(c) for c in ("value", "width", "left")])


def rebalance(s, d):
    bars = A.bar(swatches(s, d), "k")
    pair = A.drag_pair(bars, "k", 1, 62 + 1 / 3).select(F.lit("pair").alias("drag"), "k", "idx", F.round(F.col("user") + num(1e-9), 6).alias("user"))
    return pair.unionByName(A.drag_body(bars, "k", 2, 0.15).select(F.lit("body").alias("drag"), "k", "idx", F.round(F.col("user") + num(1e-9), 6).alias("user")))


def swatch_color(s, d):
    shown = [F.struct(F.lit(p).alias("preset"), F.format_string("rgb(%d, %d, %d)", *A.display_color(p)).alias("css")) for p in ("color", "hue", "contrast")]
    return swatches(s, d).select("k", "idx", F.explode(F.array(*shown)).alias("x")).select("k", "idx", "x.preset", "x.css")


SWATCH = "struct<r:double,g:double,b:double,weight:double,labL:double>"


def _swatches(k, n, shift):
    """n swatches of customer k; colours may lie outside a byte."""

    def one(j):
        values = {"r": (k * 37 + j * 91 + shift) % 300 - 20, "g": (k * 11 + j * 57 + shift) % 256, "b": (k * 5 + j * 133 + shift) % 280}
        return F.struct(*[v.cast("double").alias(c) for c, v in values.items()], ((k + j) % 10 / num(4)).alias("weight"), ((k * 13 + j * 29 + shift) % 101).cast("double").alias("labL"))

    made = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), one)
    return F.when(n > 0, made).otherwise(F.array().cast(f"array<{SWATCH}>"))


def states(s, d):
    """A state per customer: up to three source swatches, up to two target swatches, a preset and user weights for some of them."""
    k = F.col("c_custkey").cast("long")
    preset = F.element_at(F.array(*map(F.lit, [*P.LABELS, "unknown"])), (k % 6 + 1).cast("int"))
    df = table(s, d, "customer").select(k.alias("k"), preset.alias("preset"), _swatches(k, k % 4, 0).alias("source"), _swatches(k, k * 7 % 3, 50).alias("target"))
    return df.withColumn("palette", A.shown_palette(F.col("source"), F.col("target"))).withColumn("user", F.when(F.col("k") % 5 > 0, F.array(F.col("k") % 3 - num(0.5), F.col("k") % 7 / num(2))))


def stops(s, d):
    return A.gradient_stops(states(s, d), "k", F.col("palette"), F.col("preset"))


def gradient_css(s, d):
    return A.gradient_css(stops(s, d), "k")


def signature(s, d):
    """Packed colours and weights in hundredths, by place."""
    df = states(s, d).select("k", A.signature(F.col("palette"), F.col("user")).alias("x"))
    return df.select("k", F.posexplode(F.arrays_zip("x.colors", "x.weights")).alias("idx", "z")).select("k", "idx", F.col("z.colors").alias("color"), F.col("z.weights").alias("w"))


def selection(s, d):
    inside = F.col("x").between(20, 70) & F.col("y").between(2, 6)
    return tgt(s, d).select("px_id", "x", "y", F.when(inside, 255).otherwise((F.col("px_id") * 7 % 256).cast("int")).alias("m"))


def mask_of(s, d):
    """A second mask: the hard palette mask."""
    return distances(s, d).select("px_id", A.palette_mask(WEIGHTS).alias("own"))


def mask_compose(s, d):
    df = mask_of(s, d).join(selection(s, d), "px_id")
    return df.select("px_id", T.compose(F.col("own"), F.col("m"), "focus").alias("focus"), T.compose(F.col("own"), F.col("m"), "exclude").alias("exclude"))


def preview_selection(s, d):
    df = P.mapped(tgt(s, d), fitted(s, d)).join(selection(s, d).select("px_id", "m"), "px_id")
    return df.select("px_id", *[T.preview(F.col(c), F.col(f"m_{c}"), F.col("m"), "exclude").alias(c) for c in "rgb"])




def rects(s, d):
    px = tgt(s, d)
    a = T.rect(F.col("x"), F.col("y"), F.col("x") + F.col("r") % 30, F.col("y") + F.col("g") % 30)
    b = T.rect(F.lit(20), F.lit(2), F.lit(70), F.lit(60))
    return px.select("px_id", a.alias("a"), b.alias("b"))


def png(s, d):
    """Tiles of 64 rows of 100 pixels: size, size told in the header, and a digest of the stored rows, which one uncompressed block holds."""
    df = png_tiles(tgt(s, d), 100)
    rows = F.substring("png", F.lit(49), F.col("height") * 401)
    header = F.hex(F.substring("png", 17, 8))
    return df.select("tile", "height", F.octet_length("png").alias("bytes"), header.alias("size"), F.sha2(rows, 256).alias("rows_sha256"))


QUERIES = {
    "cluster_distances": cluster_distances,
    "nearest_cluster": nearest_cluster,
    "hard_weights": weights_query(0),
    "soft_weights": weights_query(SOFT),
    "palette_mask": palette_mask,
    "weighted_source": lambda s, d: A.weighted_source(weighted(s, d), "ew").select("px_id", "copy", *P.RGB, "a"),
    "weighted_hist": lambda s, d: A.weighted_histogram(weighted(s, d), "ew"),
    "kmeans_palette": kmeans,
    "palette_shares": shares,
    "palette_rebalance": rebalance,
    "swatch_color": swatch_color,
    "swatch_edges": lambda s, d: A.edges(A.bar(swatches(s, d), "k"), "k", "hue"),
    "recipe_source": lambda s, d: A.recipe_source(swatches(s, d), "k", RECIPE_PIXELS),
    "gradient_stops": stops,
    "gradient_css": gradient_css,
    "palette_signature": signature,
    "weights_active": lambda s, d: tgt(s, d).select("px_id", A.weights_active(F.array(num(1), num(1) + (F.col("r") % 3) / num(100), num(1) - (F.col("g") % 2) / num(100))).alias("active")),
    "downsample_box": lambda s, d: T.downsample(tgt(s, d), 33),
    "mask_nn": lambda s, d: T.nearest_mask(selection(s, d), T.size_of(tgt(s, d)), (37, 23)),
    "mask_paste": lambda s, d: T.paste(tgt(s, d).select("px_id", "x", "y"), selection(s, d).filter("x < 40 AND y < 5"), 15, 3).select("px_id", "m"),
    "mask_pad": lambda s, d: T.fit_length(selection(s, d).filter("px_id < 500"), tgt(s, d)),
    "selection_as_alpha": lambda s, d: T.selection_as_alpha(tgt(s, d), selection(s, d).filter("px_id % 3 <> 0")).select("px_id", *P.RGB, "a"),
    "mask_compose": mask_compose,
    "preview_selection": preview_selection,
    "png_encode": png,
    "rect_intersect": lambda s, d: rects(s, d).select("px_id", T.intersect(F.col("a"), F.col("b")).alias("i")).select("px_id", *[F.col(f"i.{k}").alias(f"{k}_") for k in T.SIDES]),
    "stats_rect": lambda s, d: rects(s, d).select("px_id", F.coalesce(T.intersect(F.col("a"), F.col("b")), F.col("a")).alias("i")).select("px_id", *[F.col(f"i.{k}").alias(f"{k}_") for k in T.SIDES]),
}

PAL = "pal(k, pl, pa, pb, w) AS (VALUES " + ", ".join(f"({c[0]}, {c[1]!r}::DOUBLE, {c[2]!r}::DOUBLE, {c[3]!r}::DOUBLE, {c[4]!r}::DOUBLE)" for c in CLUSTERS) + ")"
DIST = f"{TGT}, {PAL}, lt AS {lab('(SELECT * FROM tgt WHERE a >= 128)', 'px_id')}, ds AS (SELECT px_id, k, w, (l_-pl)*(l_-pl) + (a_-pa)*(a_-pa) + (b_-pb)*(b_-pb) d FROM lt CROSS JOIN pal)"
HARD = "hw AS (SELECT px_id, arg_min(w, (d, k)) w FROM ds GROUP BY 1)"
INV = repr(1 / ((SOFT / 100) ** 2 * 5000)) + "::DOUBLE"


def _soft(w: str, name: str) -> str:
    return f"{name} AS (SELECT px_id, sum(g*{w})/sum(g) w FROM (SELECT px_id, w, 1e0/(1 + (d - min(d) OVER (PARTITION BY px_id))*{INV}) g FROM ds) GROUP BY 1)"


EW = f"ew AS (SELECT t.*, round(coalesce(s.w, 0), 9) ew FROM tgt t LEFT JOIN sw s USING (px_id)), n AS (SELECT *, CAST(least(255, floor(ew) + CASE WHEN (((px_id+1)*2654435761) % 4294967296)/4294967296e0 < ew - floor(ew) THEN 1 ELSE 0 END) AS INT) n FROM ew)"
SW = """sws AS (SELECT k, idx, CAST((k*37 + idx*91) % 256 AS INT) r, CAST((k*11 + idx*57) % 256 AS INT) g, CAST((k*5 + idx*133) % 256 AS INT) b, ((k + idx*3) % 5)/8e0 p, ((k*7 + idx*5) % 4)/2e0 u
 FROM (SELECT CAST(c_custkey AS BIGINT) k, unnest([CAST(0 AS INT), 1, 2, 3][1:c_custkey % 3 + 2]) idx FROM customer))"""
_of = "OVER (PARTITION BY k)"
BAR = f"""{SW}, bv AS (SELECT *, greatest(0, u)*greatest(0, p) val, {luma()} y FROM sws), bw AS (SELECT *, greatest(15e-1, val/CASE WHEN sum(val) {_of} = 0 THEN 1 ELSE sum(val) {_of} END*100) w0 FROM bv),
bars AS (SELECT *, w0/sum(w0) {_of}*100 width, CAST(row_number() OVER (PARTITION BY k ORDER BY y, idx) - 1 AS INT) ord FROM bw),
bl AS (SELECT *, coalesce(sum(width) OVER (PARTITION BY k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) lft FROM bars)"""
SEL = "sel AS (SELECT px_id, x, y, CASE WHEN x BETWEEN 20 AND 70 AND y BETWEEN 2 AND 6 THEN 255 ELSE CAST((px_id*7) % 256 AS INT) END m FROM tgt)"
_side = lambda shift: ", ".join(f"CAST(({e} + {shift}) % {m} AS DOUBLE){x} {c}" for c, e, m, x in (("r", "k*37 + j*91", 300, " - 20"), ("g", "k*11 + j*57", 256, ""), ("b", "k*5 + j*133", 280, ""), ("l", "k*13 + j*29", 101, "")))
STATES = f"""cu AS (SELECT CAST(c_custkey AS BIGINT) k, ['color','hue','hueOnly','saturationOnly','contrast','unknown'][c_custkey % 6 + 1] preset FROM customer), js(j) AS (VALUES (0), (1), (2)),
sw AS (SELECT k, preset, j, ((k+j) % 10)/4e0 p, {_side(0)} FROM cu, js WHERE j < k % 4 UNION ALL SELECT k, preset, j, ((k+j) % 10)/4e0, {_side(50)} FROM cu, js WHERE k % 4 = 0 AND j < k*7 % 3)"""
_cb = lambda c: f"CAST(floor(greatest(0e0, least(255e0, {c})) + 5e-1) AS INT)"
_stops_of = lambda name: _preset(f"(SELECT * FROM st WHERE preset {'NOT IN (' + repr(list(P.LABELS)[1:])[1:-1] + ')' if name == 'color' else '= ' + repr(name)})", name, "k, i")
STOPS = f"""{STATES}, gr AS (SELECT CAST(range AS INT) i, CAST(floor(range/31e0*255 + 5e-1) AS INT) g FROM range(32)),
nr AS (SELECT k, i, arg_min(sw, (abs(l - gr.g/255e0*100), j)) s FROM sw, gr GROUP BY k, i),
st AS (SELECT cu.k, preset, gr.i, gr.g r, gr.g g, gr.g b, {', '.join(f"CASE WHEN s IS NULL THEN gr.g ELSE {_cb(f's.{c}')} END m{c}" for c in 'rgb')} FROM cu CROSS JOIN gr LEFT JOIN nr ON nr.k = cu.k AND nr.i = gr.i),
al AS ({' UNION ALL '.join(f'SELECT k, i, r, g, b FROM ({_stops_of(n)})' for n in P.LABELS)}), stops AS (SELECT k, i, r, g, b, format('{{:.6f}}', i/31e0*100) pct FROM al)"""
RECTS = "rc AS (SELECT px_id, x l, y t, x + r % 30 rr, y + g % 30 bb, greatest(x, 20) il, greatest(y, 2) it, least(x + r % 30, 70) ir, least(y + g % 30, 60) ib FROM tgt)"
BOXES = """dim AS (SELECT max(x)+1 w, max(y)+1 h FROM tgt), sc AS (SELECT w, h, 33e0/greatest(w, h) s FROM dim), nd AS (SELECT w, h, greatest(1, floor(w*s + 5e-1)) nw, greatest(1, floor(h*s + 5e-1)) nh FROM sc),
ex AS (SELECT CAST(i AS INT) o, floor(i*(w/nw)) lo, least(w, floor((i+1)*(w/nw))) hi FROM nd, LATERAL (SELECT unnest(range(CAST(nw AS BIGINT))) i)), ey AS (SELECT CAST(i AS INT) o, floor(i*(h/nh)) lo, least(h, floor((i+1)*(h/nh))) hi FROM nd, LATERAL (SELECT unnest(range(CAST(nh AS BIGINT))) i))"""
#: Rounds of k-means as a recursion over the list of centres; a centre without samples keeps its place.
KMEANS = f"""WITH RECURSIVE {TGT}, lt AS {lab('(SELECT * FROM tgt WHERE a >= 128 AND px_id % 4 = 0)', 'px_id')}, sm AS (SELECT *, row_number() OVER (ORDER BY px_id) - 1 rn, count(*) OVER () n FROM lt),
ini AS (SELECT list({{'l': l_, 'a': a_, 'b': b_}} ORDER BY rn) cs FROM sm WHERE rn IN (SELECT CAST(floor((range + 5e-1)/5e0*n) AS BIGINT) FROM range(5), (SELECT max(n) n FROM sm))),
rec AS (SELECT 0 it, cs, CAST([] AS STRUCT(c INTEGER, n BIGINT, l DOUBLE, a DOUBLE, b DOUBLE)[]) f, 1e9 moved FROM ini
UNION ALL SELECT it + 1, list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN len(list_filter(f, lambda x: x.c = i)) > 0 THEN {{'l': list_filter(f, lambda x: x.c = i)[1].l, 'a': list_filter(f, lambda x: x.c = i)[1].a, 'b': list_filter(f, lambda x: x.c = i)[1].b}} ELSE cs[i] END),
 f, list_sum(list_transform(f, lambda x: sqrt((x.l-cs[x.c].l)*(x.l-cs[x.c].l) + (x.a-cs[x.c].a)*(x.a-cs[x.c].a) + (x.b-cs[x.c].b)*(x.b-cs[x.c].b))))/5e0
 FROM (SELECT it, cs, list({{'c': c, 'n': n, 'l': l, 'a': a, 'b': b}} ORDER BY c) f FROM (SELECT it, cs, c, count(*) n, avg(l_) l, avg(a_) a, avg(b_) b
 FROM (SELECT it, cs, l_, a_, b_, CAST(list_position(ds, list_min(ds)) AS INTEGER) c FROM (SELECT it, cs, l_, a_, b_, list_transform(cs, lambda x: (l_-x.l)*(l_-x.l) + (a_-x.a)*(a_-x.a) + (b_-x.b)*(b_-x.b)) ds FROM rec, sm WHERE it < 12 AND moved >= 5e-1)) GROUP BY it, cs, c) GROUP BY it, cs)),
fin AS (SELECT cs, unnest(f) f FROM (SELECT arg_max(cs, it) cs, arg_max(f, it) f FROM rec)),
od AS (SELECT CAST(row_number() OVER (ORDER BY f.n DESC, f.c) - 1 AS INT) ord, f.n/CAST(sum(f.n) OVER () AS DOUBLE) weight, cs[f.c].l lab_l, cs[f.c].a lab_a, cs[f.c].b lab_b FROM fin),
m AS (SELECT ord r, lab_l l2, lab_a a2, lab_b b2, 0 g, 0 b FROM od), o AS ({UNLAB})"""
SQL = {
    "kmeans_palette": f"{KMEANS} SELECT ord, o_r r, o_g g, o_b b, round(weight, 9) weight, round(lab_l, 6) lab_l, round(lab_a, 6) lab_a, round(lab_b, 6) lab_b FROM od JOIN o ON o.r = od.ord",
    "cluster_distances": f"WITH {DIST} SELECT px_id, k, round(d, 6) d FROM ds",
    "nearest_cluster": f"WITH {DIST} SELECT px_id, arg_min(k, (d, k)) k FROM ds GROUP BY 1",
    "hard_weights": f"WITH {DIST}, {HARD} SELECT t.px_id, round(coalesce(h.w, 0), 6) ew FROM tgt t LEFT JOIN hw h USING (px_id)",
    "soft_weights": f"WITH {DIST}, {_soft('w', 'sw')} SELECT t.px_id, round(coalesce(s.w, 0), 6) ew FROM tgt t LEFT JOIN sw s USING (px_id)",
    "palette_mask": f"WITH {DIST}, {HARD}, {_soft('least(1e0, greatest(0e0, w))', 'sw')} SELECT t.px_id, CAST(floor(coalesce(least(1e0, greatest(0e0, h.w)), 0)*255 + 5e-1) AS INT) hard, CAST(floor(coalesce(s.w, 0)*255 + 5e-1) AS INT) soft FROM tgt t LEFT JOIN hw h USING (px_id) LEFT JOIN sw s USING (px_id)",
    "weighted_source": f"WITH {DIST}, {_soft('w', 'sw')}, {EW} SELECT px_id, CAST(c AS INT) \"copy\", r, g, b, a FROM n, LATERAL (SELECT unnest(range(1, n.n + 1)) c) WHERE n.n > 0",
    "weighted_hist": f"WITH {DIST}, {_soft('w', 'sw')}, {EW} SELECT ch, v, CAST(sum(n) AS BIGINT) n FROM (SELECT 'r' ch, r v, n FROM n WHERE a >= 128 UNION ALL SELECT 'g', g, n FROM n WHERE a >= 128 UNION ALL SELECT 'b', b, n FROM n WHERE a >= 128) WHERE n > 0 GROUP BY 1, 2",
    "palette_shares": f"WITH {BAR} SELECT k, idx, ord, round(val, 9) \"value\", round(width, 9) width, round(lft, 9) \"left\" FROM bl",
    "palette_rebalance": f"""WITH {BAR}, pr AS (SELECT k, sum(u*greatest(1e-6, p)) mass, min(lft) f, max(lft+width) t FROM bl WHERE ord IN (1, 2) GROUP BY k HAVING count(*) = 2),
ps AS (SELECT *, (greatest(f+5e-1, least(t-5e-1, 62e0 + 1e0/3e0)) - f)/(t-f) sh FROM pr),
bd AS (SELECT k, sum(val) tot0, max(val) FILTER (ord = 2) own, coalesce(sum(greatest(0, p)) FILTER (ord <> 2), 0) oth FROM bl GROUP BY k),
ba AS (SELECT *, own/tot v0, greatest(0, least(1, own/tot + 15e-2)) v1 FROM (SELECT *, CASE WHEN tot0 = 0 THEN 1 ELSE tot0 END tot FROM bd))
SELECT 'pair' drag, k, idx, round(CASE WHEN mass IS NULL THEN u WHEN ord = 1 THEN mass*sh/greatest(1e-6, p) WHEN ord = 2 THEN mass*(1-sh)/greatest(1e-6, p) ELSE u END + 1e-9, 6) "user" FROM bl LEFT JOIN ps USING (k)
UNION ALL SELECT 'body', k, idx, round(CASE WHEN own IS NULL THEN u WHEN ord = 2 THEN v1*tot/greatest(1e-6, p) WHEN 1-v0 >= 1e-6 THEN u*(1-v1)/(1-v0) WHEN oth > 1e-6 THEN (1-v1)/oth ELSE u END + 1e-9, 6) FROM bl JOIN ba USING (k)""",
    "swatch_color": f"""WITH {SW}, y AS (SELECT *, {luma()} y FROM sws) SELECT k, idx, 'color' preset, format('rgb({{}}, {{}}, {{}})', r, g, b) css FROM y
UNION ALL SELECT k, idx, 'contrast', format('rgb({{0}}, {{0}}, {{0}})', CAST(floor(y + 5e-1) AS INT)) FROM y
UNION ALL SELECT k, idx, 'hue', CASE WHEN y < 1 THEN 'rgb(140, 140, 140)' ELSE format('rgb({{}}, {{}}, {{}})', {byte('r*(140/y)')}, {byte('g*(140/y)')}, {byte('b*(140/y)')}) END FROM y""",
    "swatch_edges": f"""WITH {BAR}, sh AS (SELECT k, idx, ord, {', '.join(f'CASE WHEN y < 1 THEN 140 ELSE {byte(f"{c}*(140/y)")} END {c}c' for c in 'rgb')} FROM bl)
SELECT a.k, a.idx, b.idx "right", {', '.join(f'CAST(floor((a.{c}c+b.{c}c)/2e0 + 5e-1) AS INT) {c}' for c in 'rgb')} FROM sh a JOIN sh b ON b.k = a.k AND b.ord = a.ord+1""",
    "recipe_source": f"""WITH {SW}, v AS (SELECT *, greatest(0, u)*greatest(0, p) val FROM sws), c AS (SELECT *, greatest(1, floor(val/CASE WHEN sum(val) {_of} = 0 THEN 1 ELSE sum(val) {_of} END*{RECIPE_PIXELS} + 5e-1)) n FROM v),
e AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY idx) hi FROM c), px AS (SELECT range i FROM range({RECIPE_PIXELS})),
h AS (SELECT o.k, i, min(idx) idx FROM (SELECT DISTINCT k FROM sws) o CROSS JOIN px LEFT JOIN e ON e.k = o.k AND i < hi AND i >= hi-n GROUP BY o.k, i) SELECT h.k, i px_id, s.r, s.g, s.b, 255 a FROM h JOIN sws s ON s.k = h.k AND s.idx = coalesce(h.idx, 0)""",
    "gradient_stops": f"WITH {STOPS} SELECT * FROM stops",
    "gradient_css": f"WITH {STOPS} SELECT k, 'linear-gradient(to right, ' || string_agg(format('rgb({{}},{{}},{{}}) {{}}%', r, g, b, pct), ', ' ORDER BY i) || ')' css FROM stops GROUP BY k",
    "palette_signature": f"""WITH {STATES} SELECT k, j idx, {_cb('r')}*65536 + {_cb('g')}*256 + {_cb('b')} color, CAST(floor(p*greatest(0, coalesce(CASE WHEN k % 5 > 0 THEN CASE j WHEN 0 THEN k % 3 - 5e-1 WHEN 1 THEN (k % 7)/2e0 END END, 1e0))*100 + 5e-1) AS INT) w FROM sw
UNION ALL SELECT k, 0, {0x888888}, 100 FROM cu WHERE k NOT IN (SELECT k FROM sw)""",
    "weights_active": f"WITH {TGT} SELECT px_id, abs((r % 3)/100e0 + 1 - 1) > 1e-2 OR abs(1 - (g % 2)/100e0 - 1) > 1e-2 active FROM tgt",
    "downsample_box": f"WITH {TGT}, {BOXES} SELECT ex.o x, ey.o y, {', '.join(f'CAST(floor(sum(t.{c})/CAST(count(*) AS DOUBLE)) AS INT) {c}' for c in 'rgba')} FROM tgt t JOIN ex ON t.x >= ex.lo AND t.x < ex.hi JOIN ey ON t.y >= ey.lo AND t.y < ey.hi GROUP BY 1, 2",
    "mask_nn": f"WITH {TGT}, {SEL}, dim AS (SELECT max(x)+1 w, max(y)+1 h FROM tgt), g AS (SELECT CAST(i AS INT) x, CAST(j AS INT) y, CAST(least(w-1, floor(i/37e0*w)) AS INT) sx, CAST(least(h-1, floor(j/23e0*h)) AS INT) sy FROM dim, (SELECT range i FROM range(37)), (SELECT range j FROM range(23))) SELECT g.x, g.y, m FROM g JOIN sel ON sel.x = sx AND sel.y = sy",
    "mask_paste": f"WITH {TGT}, {SEL} SELECT t.px_id, coalesce(s.m, 0) m FROM tgt t LEFT JOIN (SELECT * FROM sel WHERE x < 40 AND y < 5) s ON t.x = s.x+15 AND t.y = s.y+3",
    "mask_pad": f"WITH {TGT}, {SEL} SELECT t.px_id, coalesce(s.m, 0) m FROM tgt t LEFT JOIN (SELECT * FROM sel WHERE px_id < 500) s USING (px_id)",
    "selection_as_alpha": f"WITH {TGT}, {SEL} SELECT px_id, r, g, b, CASE WHEN px_id % 3 <> 0 THEN m ELSE 0 END a FROM tgt JOIN sel USING (px_id)",
    "mask_compose": f"WITH {DIST}, {HARD}, {SEL}, o AS (SELECT t.px_id, CAST(floor(coalesce(least(1e0, greatest(0e0, h.w)), 0)*255 + 5e-1) AS INT) own FROM tgt t LEFT JOIN hw h USING (px_id)) SELECT px_id, (own*m + 127) >> 8 focus, (own*(255-m) + 127) >> 8 \"exclude\" FROM o JOIN sel USING (px_id)",
    "preview_selection": f"WITH {FITTED}, {M}, {SEL}, n AS (SELECT m.*, 1 - s.m/255e0 w FROM m JOIN sel s USING (px_id)) SELECT px_id, {', '.join(f'CASE WHEN w >= 999e-3 THEN m{c} WHEN w <= 1e-3 THEN n.{c} ELSE CAST(floor(n.{c} + (m{c}-n.{c})*w + 5e-1) AS INT) END {c}' for c in 'rgb')} FROM n",
    "png_encode": f"""WITH {TGT}, rw AS (SELECT y, '00' || string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY x) h FROM tgt GROUP BY y)
SELECT CAST(y // 64 AS BIGINT) tile, CAST(max(y) % 64 + 1 AS INT) height, CAST(68 + (max(y) % 64 + 1)*401 AS INT) bytes, printf('%08X%08X', 100, CAST(max(y) % 64 + 1 AS INT)) size, sha256(unhex(string_agg(h, '' ORDER BY y))) rows_sha256 FROM rw GROUP BY y // 64""",
    "rect_intersect": f"WITH {TGT}, {RECTS} SELECT px_id, {', '.join(f'CASE WHEN ir > il AND ib > it THEN i{k[0]} END {k}_' for k in ('left', 'top', 'right', 'bottom'))} FROM rc",
    "stats_rect": f"WITH {TGT}, {RECTS} SELECT px_id, {', '.join(f'CASE WHEN ir > il AND ib > it THEN i{k[0]} ELSE {o} END {k}_' for k, o in (('left', 'l'), ('top', 't'), ('right', 'rr'), ('bottom', 'bb')))} FROM rc",
}
