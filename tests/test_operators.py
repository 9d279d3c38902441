"""Invariants, hand-computed cases and literal loops for operators."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import color as K
from tessera.match import Params, match
from tessera.operators import curves as C
from tessera.operators import dist as D
from tessera.operators import admission as X
from tessera.operators import folds as H
from tessera.operators import layers as L
from tessera.operators import palette as A
from tessera.operators import pixels as P
from tessera.operators import raster as T
from tessera.operators import recipes as R
from tessera.sources import files as S
from tessera.streaming import events as E
from tessera.plans import fits

PX = "px_id long, x int, y int, r int, g int, b int, a int"


def lcg_pixels(spark, n, seed, width=64):
    out, s = [], seed
    for i in range(n):
        v = []
        for _ in range(3):
            s = (s * 1664525 + 1013904223) % 2**32
            v.append(s >> 8 & 255)
        out.append((i, i % width, i // width, *v, 255))
    return spark.createDataFrame(out, PX)


def curve_row(spark, *curves):
    return spark.createDataFrame([tuple(curves)], ", ".join(f"{c} array<int>" for c in "rgb"[: len(curves)]))


IDENTITY = list(range(256))


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("mode", ["full", "mean", "median", "percentiles"])
def test_a_relation_matches_itself(spark, mode):
    px = lcg_pixels(spark, 4096, 42)
    rows = D.fit(px, px, mode).collect()
    assert len(rows) == 768
    assert max(abs(r["out"] - r["v"]) for r in rows) < (3 if mode == "full" else 2)


def test_lab_fit_of_itself_is_near_the_identity(spark):
    px = lcg_pixels(spark, 4096, 7)
    seen = {r["r"] for r in px.select("r").distinct().collect()}
    rows = D.fit_lab(px, px).filter("ch = 'r'").collect()
    assert max(abs(r["out"] - r["v"]) for r in rows if r["v"] in seen) < 8


def test_empty_relations(spark):
    none, some = spark.createDataFrame([], PX), lcg_pixels(spark, 64, 1)
    assert {r["out"] for r in D.fit_full(some, none).collect()} == {0}
    assert {r["out"] for r in D.fit_full(none, some).collect()} <= {0, 255}
    assert all(r["out"] == r["v"] for r in D.fit_mean(none, some).collect())
    assert all(r["out"] == r["v"] for r in D.fit_lab(none, none).collect())
    assert [r["q"] for r in D.percentiles(none, (0.5,)).collect()] == [[128]] * 3
    assert tuple(D.luma_range(D.luma_bins(none)).first()) == (0, 255)


def test_luma_bins_of_known_colours(spark):
    px = spark.createDataFrame([(i, i, 0, *c) for i, c in enumerate([(0, 0, 0, 255), (255, 255, 255, 255), (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (9, 9, 9, 0)])], PX)
    n = {r["l"]: r for r in D.luma_bins(px).collect() if r["n"]}
    assert sorted(n) == [0, 18, 54, 182, 255]
    assert n[54]["sum_r"] == n[182]["sum_g"] == n[18]["sum_b"] == 255


def loop_cap(curve, ratio, start=0, end=255):
    out, hold = list(curve), lambda x: max(0, min(255, math.floor(x + 0.5)))
    for v in range(start + 1, end + 1):
        out[v] = hold(out[v - 1] + ratio * math.tanh((out[v] - out[v - 1]) / ratio))
    for v in range(end - 1, start - 1, -1):
        out[v] = hold(out[v + 1] + ratio * math.tanh((out[v] - out[v + 1]) / ratio))
    return out


def test_cap_equals_the_loop(spark):
    steep = [min(255, 4 * i) for i in range(256)]
    df = curve_row(spark, steep)
    assert one(df, C.cap(F.col("r"), 2.5)) == loop_cap(steep, 2.5)
    ranged = one(df, C.cap(F.col("r"), 1.0, 50, 200))
    assert ranged == loop_cap(steep, 1.0, 50, 200)
    assert ranged[:50] == steep[:50] and ranged[201:] == steep[201:]
    assert one(df, C.cap(F.col("r"), 0)) == steep


def test_amount_smooth_and_defaults(spark):
    bent = [min(255, i + i % 2) for i in range(256)]
    df = curve_row(spark, bent)
    assert one(df, C.process(F.col("r"), 0.0)) == IDENTITY
    assert one(df, C.process(F.col("r"), 1.0)) == bent
    mirror = lambda i: -i if i < 0 else 510 - i if i > 255 else i
    assert one(df, C.smooth(F.col("r"), 3)) == [math.floor(sum(bent[mirror(v + k)] for k in range(-3, 4)) / 7 + 0.5) for v in range(256)]
    sloped = curve_row(spark, [min(255, max(0, math.floor(0.9 * i + 10.5))) for i in range(256)], [min(255, math.floor(1.1 * i + 0.5)) for i in range(256)], IDENTITY)
    row = sloped.select(*[x.alias(c) for c, x in zip("rgb", C.dimensions(*map(F.col, "rgb"), C.Dimensions()), strict=True)]).first()
    assert tuple(row) == tuple(sloped.first())


def test_zone_and_envelope_weights(spark):
    df = spark.range(1)
    assert all(0.999 < w < 1.001 for w in one(df, C.zone_weights()))
    dip = one(df, C.zone_weights((C.Zone(100, 42), C.Zone(0, 127), C.Zone(100, 212))))
    assert dip[127] < 0.5 and dip[0] > 0.9 and dip[255] > 0.9
    assert one(df, C.zone_weights((C.Zone(100, 42), C.Zone(0, 127, 50, 100), C.Zone(100, 212))))[127] < 0.1
    assert set(one(df, C.envelope_weights(()))) == {1.0} and set(one(df, C.envelope_weights((C.Knot(9, 0.5),)))) == {0.5}
    ramp = one(df, C.envelope_weights((C.Knot(192, 1, False), C.Knot(64, 0, False))))
    assert abs(ramp[96] - 0.25) < 0.005 and abs(ramp[128] - 0.5) < 0.005 and ramp[0] == 0 and ramp[255] == 1
    valley = one(df, C.envelope_weights((C.Knot(0, 1.5), C.Knot(127, 0), C.Knot(255, 1.5))))
    assert min(valley) >= 0 and max(valley) <= 1.5 + 1e-9 and valley[127] == 0
    with pytest.raises(ValueError):
        C.envelope_weights((C.Knot(0, float("nan")), C.Knot(1, 1)))


def test_tables_keep_grid_points_and_alpha(spark):
    greys = [(n, n, 0, *[math.floor(n / 32 * 255 + 0.5)] * 3, n) for n in range(33)]
    px = spark.createDataFrame(greys, PX)
    grid = P.lut_grid(curve_row(spark, IDENTITY, IDENTITY, IDENTITY), 33)
    assert sorted(tuple(r) for r in P.apply_lut(px, grid, 33).collect()) == greys
    assert grid.count() == 35937


def test_weighted_steps_round_down(spark):
    df = spark.createDataFrame([(100, 101, w) for w in (-1.0, 0.0, 0.5, 1.0, 2.0)] + [(100, 99, 0.5)], "o int, n int, w double")
    assert [r[0] for r in df.select(P.weighted(F.col("o"), F.col("n"), F.col("w"))).collect()] == [100, 100, 100, 101, 101, 99]


def test_full_masks_compose_to_254(spark):
    assert one(spark.range(1), T.compose(F.lit(255), F.lit(255))) == 254
    assert one(spark.range(1), T.compose(F.lit(7), F.lit(None).cast("int"))) == 7


def loop_kmeans(lab, k):
    centres = [lab[math.floor((c + 0.5) / k * len(lab))] for c in range(k)]
    for _ in range(12):
        near = [min(range(k), key=lambda c: (sum((p - q) ** 2 for p, q in zip(s, centres[c], strict=True)), c)) for s in lab]
        moved = 0
        for c in range(k):
            own = [s for s, n in zip(lab, near, strict=True) if n == c]
            if own:
                new = tuple(math.fsum(x) / len(own) for x in zip(*own, strict=True))
                moved += math.dist(new, centres[c])
                centres[c] = new
        if moved / k < 0.5:
            break
    counts = [near.count(c) for c in range(k)]
    return [(counts[c] / len(lab), *centres[c]) for c in sorted(range(k), key=lambda c: (-counts[c], c)) if counts[c]]


def test_kmeans_equals_the_loop(spark):
    px = lcg_pixels(spark, 2000, 99).withColumn("a", F.when(F.col("px_id") % 5 == 0, 0).otherwise(255)).cache()
    lab = [tuple(r)[1:] for r in A.samples(px).orderBy("px_id").collect()]
    got = [(r["weight"], r["lab_l"], r["lab_a"], r["lab_b"]) for r in A.kmeans(px, 5).orderBy("ord").collect()]
    want = loop_kmeans(lab, 5)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(abs(x - y) < 1e-6 for x, y in zip(a, b, strict=True))
    assert A.kmeans(px.filter("px_id < 9"), 5).count() == 2
    assert A.kmeans(px.filter("px_id < 0"), 5).count() == 0
    px.unpersist()


def test_neutral_and_empty_palettes(spark):
    assert one(spark.range(1), A.weights_active(F.array(F.lit(1.0), F.lit(1.005)))) is False
    px = A.with_distances(lcg_pixels(spark, 8, 3), [(50.0, 0.0, 0.0)])
    assert {r[0] for r in px.select(A.effective_weight([])).collect()} == {0.0}


def test_hsl_round_trip(spark):
    df = spark.createDataFrame([(r, g, b) for r in (0, 3, 128, 255) for g in (0, 77, 255) for b in (0, 200, 255)], "r int, g int, b int")
    h, s, light = K.rgb_to_hsl(*map(F.col, "rgb"))
    back = df.withColumns({"h": h, "s": s, "l": light}).select("r", "g", "b", *[c.alias(f"o{i}") for i, c in enumerate(K.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l")))])
    assert all(tuple(r)[:3] == tuple(r)[3:] for r in back.collect())


def test_history_cap_window_and_pins(spark):
    def entries(rows):
        return spark.createDataFrame([(1, i, ms, k, p) for i, (ms, k, p) in enumerate(rows)], "user_id long, id long, ms long, key string, pinned boolean")

    ids = lambda rows: [r["id"] for r in H.push_history(entries(rows)).orderBy("pos").collect()]
    assert ids([(i * 5000, f"p{i}", False) for i in range(7)]) == [6, 5, 4, 3, 2]
    assert ids([(0, "a", False), (10, "a", False)]) == [0]
    assert ids([(0, "a", False), (10, "b", False), (20, "a", False)]) == [2, 1, 0]
    assert ids([(0, "a", False), (1500, "a", False), (2500, "a", False)]) == [2, 0]
    assert ids([(0, "x", True)] + [(i * 5000, f"p{i}", False) for i in range(1, 8)]) == [0, 7, 6, 5, 4, 3]


def test_undo_states():
    u = H.Undo()
    for s in ("a", "a", "b", "c"):
        u.change(s)
    u.undo()
    assert (u.present, u.past, u.future) == ("b", ["a"], ["c"])
    u.redo()
    u.redo()
    assert u.present == "c"
    u.undo()
    u.change("d")
    assert (u.present, u.future) == ("d", [])


def test_recipes_of_bad_files(spark):
    texts = ["", "nonsense", "[]", '{"format":"other"}', '{"format":"tessera-recipes","version":9,"entries":[]}', '{"format":"tessera-recipes","version":1}', '{"format":"tessera-recipes","version":1,"entries":[null,{"id":""},{"id":"a","timestamp":1,"label":"l","state":{},"signature":{"colors":[],"weights":[]}}]}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: (r["status"], r["entries"]) for r in R.parse(df).collect()}
    assert [got[i][0] for i in range(len(texts))] == ["json", "json", "json", "tag", "version", "entries", "ok", "json"]
    assert got[6][1] == []


def test_packets_keep_literal_entities(spark):
    df = spark.createDataFrame([('{"a":"&lt; <b> &amp;"}',), ("{}",)], "j string")
    assert [r[0] for r in df.select(R.packet_body(R.packet(F.col("j")))).collect()] == ['{"a":"&lt; <b> &amp;"}', "{}"]
    assert one(spark.range(1), R.packet_body(F.lit("no packet"))) is None


def test_layers_of_odd_trees(spark):
    schema = "layer_id long, parent_id long, ord int, name string, kind string, visible boolean"
    rows = [(1, None, 0, "A", "group", True), (2, 1, 0, "Match", "group", True), (3, 2, 0, "x", "pixel", True), (4, 1, 1, "y", "pixel", False), (5, None, 1, "Match", "group", True), (6, 5, 0, "z", None, True)]
    df = spark.createDataFrame(rows, schema)
    ours = F.col("name") == "Match"
    assert {tuple(r) for r in L.paths(df, ours).collect()} == {(4, "A / y")}
    assert {(r["layer_id"], r["parent_id"]) for r in L.consolidate(df, ours).collect()} == {(1, None), (3, 5), (4, 1), (5, None), (6, 5)}
    assert L.next_branch(df, "Match").first()["name"] == "Match _01"
    assert L.paths(spark.createDataFrame([], schema), ours).count() == 0


def test_layers_of_deep_trees_and_circles(spark):
    schema = "layer_id long, parent_id long, ord int, name string, kind string, visible boolean"
    rows = [(i, i - 1 if i else None, 0, "g", "group" if i < 67 else "pixel", True) for i in range(68)]
    df = spark.createDataFrame([*rows, (100, 0, 1, "z", "pixel", True)], schema).repartition(1)
    assert {r["layer_id"] for r in L.isolate(df, 67).collect() if r["visible"]} == set(range(68))
    assert {r["layer_id"]: len(r["path"].split(" / ")) for r in L.paths(df, F.lit(False)).collect()} == {67: 68, 100: 2}
    circle = spark.createDataFrame([(1, 2, 0, "a", "group", True), (2, 1, 0, "b", "group", True), (3, None, 0, "c", "group", True)], schema)
    assert sorted((r["layer_id"], r["visible"]) for r in L.isolate(circle, 1).collect()) == [(1, True), (2, True), (3, False)]
    hanging = spark.createDataFrame([(9, 8, 0, "d", "pixel", True), (8, 7, 0, "e", "group", True), (3, None, 0, "c", "pixel", True)], schema)
    for df in (circle, circle.union(spark.createDataFrame([(i, 1 if i == 10 else i - 1, 0, "x", "pixel", True) for i in range(10, 40)], schema)), circle.union(hanging)):
        with pytest.raises(ValueError, match="own ancestors"):
            L.paths(df, F.lit(False))
    assert [tuple(r) for r in L.paths(hanging, F.lit(False)).collect()] == [(3, "c")]


def test_a_chain_takes_as_many_rounds_as_its_depth_has_bits(spark, monkeypatch):
    depth, written = 4096, []
    monkeypatch.setattr(L, "materialize", lambda df, name, write=L.materialize: written.append(name) or write(df, name))
    chain = spark.range(depth).select(F.col("id").alias("layer_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).alias("ord"), F.col("id").cast("string").alias("name"), F.lit("group").alias("kind"), F.lit(True).alias("visible"))
    last = L.levels(chain).filter(f"layer_id = {depth - 1}").first()
    assert last["depth"] == depth - 1 and last["names"] == [str(i) for i in range(depth)]
    assert written.count("ways") <= 14  # the start and 13 rounds
    written.clear()
    assert L.isolate(chain, 3000).filter("visible").agg(F.min("layer_id"), F.max("layer_id"), F.count("*")).first() == (0, 3000, 3001)
    assert written.count("ancestors") <= 14


def test_throttle_streams_like_the_batch(spark, tmp_path):
    rows = [(u, i, u * 7 + i * (40 + u * 13) % 1500 + i * 11, float(i)) for u in range(3) for i in range(60)]
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    rows = [(u, i, ms, v) for i, (u, _, ms, v) in enumerate(rows)]
    schema = "user_id long, id long, ms long, value double"
    batch = spark.createDataFrame(rows, schema)
    early = [r for r in rows if r[2] < 700]
    for part in (early, [r for r in rows if r[2] >= 700]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = E.throttle_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 200)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in X.throttle(batch, 200).collect()}
    last = {u: max(w[1] for w in want if w[0] == u) for u in range(3)}
    assert got == {w for w in want if w[1] != last[w[0]]}


def test_png_tiles_decode_to_their_pixels(spark):
    px = lcg_pixels(spark, 64 * 70, 5)
    pixels = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in px.collect()}
    for r in S.png_tiles(px, 64).collect():
        data = bytes(r["png"])
        at = data.index(b"IDAT")
        body = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
        for y in range(r["height"]):
            row = body[y * 257 + 1 : (y + 1) * 257]
            assert all(tuple(row[4 * x : 4 * x + 4]) == pixels[x, r["tile"] * 64 + y] for x in range(64))


def test_profile_and_texts(spark, tmp_path):
    grid = P.lut_grid(curve_row(spark, IDENTITY, IDENTITY, IDENTITY), 5)
    made = bytes(S.profile(P.icc_clut(grid, 5), b"head", b"tail").first()["profile"])
    axis = [math.floor(i / 4 * 255 + 0.5) * 257 for i in range(5)]
    assert made == b"head" + b"".join(struct.pack(">3H", r, g, b) for r in axis for g in axis for b in axis) + b"tail"
    S.write_lines(P.cube_lines(grid, 5, "color", "T"), f"{tmp_path}/cube")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "cube").glob("part-*"))).split("\n")
    assert lines[2] == "LUT_3D_SIZE 5" and lines[6] == "0.000000 0.000000 0.000000" and lines[7].split()[1:] == ["0.000000", "0.000000"] and len(lines) == 6 + 125 + 1


def test_settings_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"name":"a","state":{"preset":"hue","dimensions":{"value":120},"unknown":1},"saved_ms":5}\nnot json\n')
    rows = S.read_settings(spark, f"{tmp_path}/s.json").collect()
    assert rows[0]["state"]["preset"] == "hue" and rows[0]["state"]["dimensions"] == {"value": 120.0} and rows[1]["name"] is None
    S.write_settings(S.read_settings(spark, f"{tmp_path}/s.json").filter("name IS NOT NULL"), f"{tmp_path}/out")
    assert S.read_settings(spark, f"{tmp_path}/out").count() == 1


def test_the_front(spark):
    a, b = lcg_pixels(spark, 512, 1), lcg_pixels(spark, 512, 2)
    made = match(a, b, Params(max_stretch=8, smooth=2, dimensions=C.Dimensions(contrast=110), envelope=(C.Knot(0, 0.5), C.Knot(255, 1)), preset="hue"))
    assert made.apply(b).count() == 512 and made.control_points().count() == 36 and made.to_lut(5).count() == 125
    rows = made.rows().orderBy("v").collect()
    assert all(x[c] <= y[c] for x, y in zip(rows, rows[1:], strict=False) for c in "rgb")


def test_presets_with_a_weight(spark):
    """The preset's blend first, then as much of it as the weight says: the ends are the original and the preset alone."""
    from tessera.match import Curves, Params

    px = spark.createDataFrame([(i, i * 7 % 256, i * 31 % 256, i * 11 % 256, 255, w) for i in range(60) for w in (0.0, 0.3, 1.0)], "px_id long, r int, g int, b int, a int, w double")
    curves = spark.range(1).select(*[F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v, k=k: (v * (k + 2) + 31) % 256).cast("array<int>").alias(c) for k, c in enumerate("rgb")])
    for name in P.LABELS:
        fitted = Curves(curves, Params(preset=name))
        alone = {(r["px_id"]): (r["r"], r["g"], r["b"]) for r in fitted.apply(px.filter("w = 1")).collect()}
        before = {r["px_id"]: (r["r"], r["g"], r["b"]) for r in px.filter("w = 1").collect()}
        for r in fitted.apply(px, "w").collect():
            own, new = before[r["px_id"]], alone[r["px_id"]]
            w = int(r["w"] * 256 + 0.5)
            assert (r["r"], r["g"], r["b"]) == tuple(n if w == 256 else o + ((n - o) * w >> 8) for o, n in zip(own, new, strict=True)), name


def test_gradients_and_signatures_of_odd_states(spark):
    swatch = "struct<r:double,g:double,b:double,weight:double,labL:double>"
    nan = float("nan")
    rows = [(1, [], "color"), (2, None, None), (3, [(10.0, 20.0, 30.0, 1.0, 50.0)], "color"), (4, [(0.0, 0.0, 200.0, 0.5, 20.0), (250.0, 240.0, 0.0, 0.5, 90.0)], "color"), (5, [(nan, 300.0, -5.0, nan, nan)], "color"), (6, [(10.0, 20.0, 30.0, 1.0, 50.0)], "contrast")]
    df = spark.createDataFrame(rows, f"k long, p array<{swatch}>, preset string")
    stops = {}
    for r in A.gradient_stops(df, "k", F.col("p"), F.col("preset")).collect():
        stops.setdefault(r["k"], {})[r["i"]] = (r["r"], r["g"], r["b"])
    grey = [int(i / 31 * 255 + 0.5) for i in range(32)]
    assert [stops[1][i] for i in range(32)] == [stops[2][i] for i in range(32)] == [(g, g, g) for g in grey]
    assert set(stops[3].values()) == {(10, 20, 30)} and set(stops[5].values()) == {(0, 255, 0)}
    assert stops[4][0] == (0, 0, 200) and stops[4][31] == (250, 240, 0) and len(set(stops[4].values())) == 2
    assert set(stops[6].values()) == {(19, 19, 19)}  # the luma of the swatch, on greys
    css = {r["k"]: r["css"] for r in A.gradient_css(A.gradient_stops(df, "k", F.col("p"), F.col("preset")), "k").collect()}
    assert css[3].startswith("linear-gradient(to right, rgb(10,20,30) 0.000000%, ") and css[3].endswith("rgb(10,20,30) 100.000000%)")
    sig = [(1, None, None), (2, [], [2.0]), (3, [(255.0, 0.0, 0.0, 0.5, 0.0), (0.0, 255.0, 0.0, 0.25, 0.0)], None), (4, [(-10.0, 300.0, 128.0, 1.0, 0.0), (1.0, 1.0, 1.0, nan, 0.0)], [nan]), (5, [(0.0, 0.0, 1.0, 0.5, 0.0)], [-3.0])]
    got = spark.createDataFrame(sig, f"k long, p array<{swatch}>, u array<double>").select("k", A.signature(F.col("p"), F.col("u")).alias("s")).collect()
    assert {r["k"]: (r["s"]["colors"], r["s"]["weights"]) for r in got} == {1: ([0x888888], [100]), 2: ([0x888888], [100]), 3: ([0xFF0000, 0x00FF00], [50, 25]), 4: ([0x00FF80, 0x010101], [100, 0]), 5: ([1], [0])}


def test_profile_prefix_is_patched():
    made = S.sized_prefix(bytes(372), bytes(14), 17)
    assert int.from_bytes(made[:4], "big") == 372 + 6 * 17**3 + 14 and int.from_bytes(made[164:168], "big") == 6 * 17**3 + 76 and made[0x13E] == 17
    assert S.sized_prefix(bytes(372), b"", 256)[0x13E] == 0
    with pytest.raises(ValueError):
        S.sized_prefix(bytes(372), b"", 1)


def test_merge_report_and_fresh_names_of_empty_tables(spark):
    none = spark.createDataFrame([], "key string, ord long, pinned boolean")
    some = spark.createDataFrame([("a", 1, False), ("a", 2, False), (None, 3, False)], "key string, ord long, pinned boolean")
    assert tuple(R.merge_report(none, none).first()) == (0, 0)
    assert tuple(R.merge_report(some.filter("ord = 1"), some).first()) == (1, 2)
    assert R.fresh_names(spark.createDataFrame([(1, "old"), (2, "kept")], "k long, name string"), spark.createDataFrame([(1, "new")], "k long, name string"), "k").orderBy("k").collect()[0]["name"] == "new"


def test_paused_events_wait_for_the_resume(spark):
    rows = [(1, 0, 5, "event"), (1, 1, 6, "pause"), (1, 2, 7, "event"), (1, 3, 9, "resume"), (1, 4, 9, "event"), (1, 5, 11, "pause"), (1, 6, 12, "event"), (2, 7, 1, "resume"), (2, 8, 2, "event")]
    got = E.flush_pauses(spark.createDataFrame(rows, "user_id long, id long, ms long, act string")).collect()
    assert {r["id"]: r["at_ms"] for r in got} == {0: 5, 2: 9, 4: 9, 6: None, 8: 2}


def test_throttle_streams_fire_by_watermark(spark, tmp_path):
    schema = "user_id long, ms long, value double, ts timestamp"
    stamp = F.timestamp_millis("ms").alias("ts")
    batches = [[(1, 10_000, 1.0), (1, 10_050, 2.0), (2, 10_060, 5.0)], [(3, 100_000, 9.0)], [(3, 100_001, 9.5)]]
    for b in batches:
        spark.createDataFrame(b, "user_id long, ms long, value double").select("*", stamp).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    q = E.throttle_stream(stream, 200).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("fired").collect()) == [(1, 10_000, 10_200, 2, 2.0), (2, 10_060, 10_260, 1, 5.0)]


def test_written_tables_go_and_the_folder_must_be_shared(spark):
    from tessera.sources import shared

    df = shared.materialize(spark.range(3), "three")
    assert df.count() == 3
    shared.discard(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.written_path)

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    with pytest.raises(ValueError):
        shared.shared_dir(Far)


def test_working_group_is_set_aside(spark):
    schema = "layer_id long, parent_id long, ord int, name string, kind string, visible boolean"
    rows = [(1, None, 1, "A", "group", True), (2, 1, 0, "[M]", "group", True), (3, None, 2, "[M]", "group", True), (4, None, 0, "[M] _11x", "pixel", True), (5, None, 3, "M _40", "pixel", True)]
    df = spark.createDataFrame(rows, schema)
    assert {(r["layer_id"], r["name"], r["visible"]) for r in L.branch(df, "[M]").collect()} == {(1, "A", True), (2, "[M] _12", False), (3, "[M]", True), (4, "[M] _11x", True), (5, "M _40", True)}
    assert L.first_of(df, F.col("name") == "[M]").first()["layer_id"] == 2
    assert L.first_of(df, F.col("name") == "none").count() == 0
    assert {tuple(r) for r in L.branch(df.filter("layer_id > 3"), "[M]").collect()} == {tuple(r) for r in rows if r[0] > 3}
    hidden = L.visibility(df.withColumn("name", F.when(F.col("layer_id") == 2, "ours").when(F.col("layer_id") == 4, "Match Lab").otherwise(F.col("name"))), F.col("name") == "ours", "rgb")
    assert {r["layer_id"] for r in hidden.collect() if r["visible"]} == {1, 2, 3, 4, 5}


def test_masks_without_a_selection(spark):
    grid = spark.createDataFrame([(0, 0), (1, 0)], "x int, y int")
    mask = spark.createDataFrame([(0, 0, 9)], "x int, y int, m int")
    assert [r["m"] for r in T.paste(grid, mask, 5, 5).collect()] == [0, 0]
    none = T.paste(grid, None)
    assert [r["m"] for r in none.collect()] == [None, None]
    assert [r["c"] for r in none.select(T.compose(F.lit(77), F.col("m")).alias("c")).collect()] == [77, 77]
    assert {r["m"] for r in T.full_mask(spark.range(3).withColumnRenamed("id", "px_id")).collect()} == {255}


def test_zones_and_envelopes_of_a_row_are_those_of_a_parameter(spark):
    zones = (C.Zone(80, 42, 50, 10), C.Zone(60, 127, 40, -20), C.Zone(120, 212, 70, 0))
    sets = [(), (C.Knot(5, -3),), (C.Knot(255, 2), C.Knot(0, 0.5)), (C.Knot(0, 0.2), C.Knot(60, 1.5), C.Knot(127, 0.4, True), C.Knot(200, 1, False), C.Knot(255, 1.8)), (C.Knot(30, 1), C.Knot(30, 2), C.Knot(90, 2), C.Knot(91, 0, False)), (C.Knot(10, 1), C.Knot(20, 9), C.Knot(250, 9.1))]
    rows = [(i, [(float(z.amount), float(z.anchor), float(z.falloff), float(z.bias)) for z in zones], [(float(q.position), float(q.weight), q.smooth) for q in k]) for i, k in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, zones array<struct<amount: double, anchor: double, falloff: double, bias: double>>, knots array<struct<position: double, weight: double, smooth: boolean>>")
    for r in df.select("i", C.zone_weights_of(F.col("zones")).alias("z"), C.envelope_weights_of(F.col("knots")).alias("e"), C.zone_weights(zones).alias("wz")).collect():
        want = spark.range(1).select(C.envelope_weights(sets[r["i"]])).first()[0]
        assert r["z"] == pytest.approx(r["wz"], abs=1e-12) and r["e"] == pytest.approx(want, abs=1e-9), sets[r["i"]]
    bad = spark.createDataFrame([([(1.0, None, True), (2.0, 1.0, True)],)], "knots array<struct<position: double, weight: double, smooth: boolean>>")
    assert bad.select(C.envelope_weights_of(F.col("knots"))).first()[0] is None


def test_palettes_without_the_dragged_places_stay(spark):
    df = spark.createDataFrame([(1, 0, 9, 9, 9, 0.5, 1.0), (1, 1, 200, 9, 9, 0.5, 1.0), (None, 0, 1, 1, 1, 1.0, 3.0)], "k int, idx int, r int, g int, b int, weight double, user double")
    bars = A.bar(df, "k")
    assert {(r["k"], r["idx"], r["user"]) for r in A.drag_pair(bars, "k", 1, 50.0).collect()} == {(1, 0, 1.0), (1, 1, 1.0), (None, 0, 3.0)}
    assert {r["user"] for r in A.drag_body(bars, "k", 2, 0.5).collect()} == {1.0, 3.0}
    assert {(r["k"], r["n"]) for r in A.recipe_source(df, "k", 10).groupBy("k").agg(F.countDistinct("px_id").alias("n")).collect()} == {(1, 10), (None, 10)}


def test_an_envelope_finds_a_values_piece_once(spark):
    """Each use of a value's piece or place looked it up anew before, some tens of times a value."""
    df = spark.range(1).select(F.array(*[F.struct(F.lit(float(x)).alias("position"), F.lit(1.0).alias("weight"), F.lit(True).alias("smooth")) for x in (0, 99, 255)]).alias("knots"))
    plan = df.select(C.envelope_weights_of(F.col("knots")).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") == 1


@pytest.mark.parametrize("name", ["envelope_polyline", "envelope_weights", "zone_weights"])
def test_rows_that_make_many_are_spread(spark, name):
    """One small file of suppliers is more than one task's work."""
    df = fits.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.select(F.spark_partition_id()).distinct().count() > 1
