"""Recipes and histories: parsing, validation, serialising, labels, keys, merging, restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.color import half_up, num, pack

FORMAT, VERSION = "tessera-recipes", 1
SWATCH = "struct<r:int,g:int,b:int,weight:double,labL:double,labA:double,labB:double>"
STATE = f"struct<xmpVersion:int,toolVersion:string,preset:string,outputMode:string,colorSpace:string,paletteCount:int,sourcePaletteSwatches:array<{SWATCH}>,sourcePaletteWeights:array<double>,sourceSoftness:double,targetPaletteSwatches:array<{SWATCH}>,targetPaletteWeights:array<double>,targetSoftness:double,selectionMode:string,matchMode:string,paletteAdaptive:boolean,dimensions:map<string,double>,zones:map<string,double>,envelope:array<struct<position:double,weight:double,smooth:boolean>>,lutStrength:double,lutGrid:int,lutDither:boolean,sourceDocId:bigint,sourceLayerId:bigint,targetDocId:bigint,targetLayerId:bigint>"
ENTRY = f"struct<id:string,timestamp:bigint,label:string,customName:string,pinned:boolean,state:{STATE},signature:struct<colors:array<int>,weights:array<int>>>"
FILE = f"struct<format:string,version:int,exportedAt:string,entries:array<{ENTRY}>>"
IDS = ("sourceDocId", "sourceLayerId", "targetDocId", "targetLayerId")


def valid_entry(e: Column, state_json: Column) -> Column:
    """An entry with a name, a time, a label, a signature of two lists and a state that is not empty."""
    return F.coalesce((F.length(e["id"]) > 0) & e["timestamp"].isNotNull() & e["label"].isNotNull() & e["signature"]["colors"].isNotNull() & e["signature"]["weights"].isNotNull() & (F.size(F.json_object_keys(state_json)) > 0), F.lit(False))


def parse(files: DataFrame, text: str = "text") -> DataFrame:
    """files with status (ok, json, tag, version, entries) and entries, the valid ones."""
    raw = F.col(text)
    file = F.from_json(raw, FILE, {"mode": "PERMISSIVE"})
    kind = F.try_variant_get(F.try_parse_json(raw), "$", "variant")
    states = F.transform(F.from_json(F.get_json_object(raw, "$.entries"), "array<struct<state:string>>"), lambda s: s["state"])
    df = files.withColumns({"_file": file, "_states": states, "_ok": kind.isNotNull() & raw.startswith("{")})
    status = F.when(~F.coalesce("_ok", F.lit(False)), "json").when(~F.coalesce(F.col("_file.format") == FORMAT, F.lit(False)), "tag").when(~F.coalesce(F.col("_file.version") <= VERSION, F.lit(False)), "version").when(F.col("_file.entries").isNull(), "entries").otherwise("ok")
    kept = F.transform(F.filter(F.arrays_zip(F.col("_file.entries").alias("e"), F.col("_states").alias("s")), lambda z: valid_entry(z["e"], z["s"])), lambda z: z["e"])
    return df.withColumn("status", status).withColumn("entries", F.when(F.col("status") == "ok", kept)).drop("_file", "_states", "_ok")


def serialize(entries: Column, exported_at: str) -> Column:
    """The file of an array of entries: without pins and the numbers of local documents and layers."""
    bare = F.transform(entries, lambda e: e.dropFields("pinned").withField("state", e["state"].dropFields(*IDS)))
    return F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(exported_at).alias("exportedAt"), bare.alias("entries")))


def escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape(s: Column) -> Column:
    """The ampersand comes last, so that a literal &lt; survives."""
    for a, b in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def packet(json: Column) -> Column:
    """An XML packet around a JSON document."""
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n  <rdf:Description rdf:about="" xmlns:t="urn:tessera">\n   <t:State>'
    return F.concat(F.lit(head), escape(json), F.lit("</t:State>\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>"))


def packet_body(text: Column) -> Column:
    """The JSON document in a packet, null if there is none."""
    body = F.regexp_extract(text, r"<(?:\w+:)?State[^>]*>([\s\S]*?)</(?:\w+:)?State>", 1)
    return F.when(body != "", unescape(body))


def mode_of(state: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(state["outputMode"]), blank(state["colorSpace"]), F.lit("rgb"))


def label(state: Column) -> Column:
    """MODE · Preset · N swatches, at most 40 characters."""
    preset = F.coalesce(F.when(state["preset"] != "", state["preset"]), F.lit("Custom"))
    n = F.coalesce(state["paletteCount"], F.greatest(F.size(state["sourcePaletteSwatches"]), F.lit(0)), F.lit(0))
    text = F.concat(F.upper(mode_of(state)), F.lit(" · "), F.upper(F.substring(preset, 1, 1)), F.lower(F.substring(preset, F.lit(2), F.length(preset))), F.lit(" · "), n.cast("string"), F.lit(" swatches"))
    return F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 39), F.lit("…"))).otherwise(text)


def dedup_key(state: Column) -> Column:
    """Mode, preset, count, weights in thousandths, softness and swatches, with bars between."""
    weights = F.array_join(F.transform(F.coalesce(state["sourcePaletteWeights"], F.array().cast("array<double>")), lambda w: F.floor(F.coalesce(w, num(0)) * num(1000) + num(0.5)).cast("string")), ",")
    soft = F.coalesce(state["sourceSoftness"], num(0))
    soft_text = F.when(soft == F.floor(soft), F.floor(soft).cast("string")).otherwise(soft.cast("string"))
    colors = F.array_join(F.transform(F.coalesce(state["sourcePaletteSwatches"], F.array().cast(f"array<{SWATCH}>")), lambda s: F.concat_ws(",", *[F.coalesce(s[c], F.lit(0)).cast("string") for c in "rgb"])), ";")
    return F.concat_ws("|", mode_of(state), F.coalesce(state["preset"], F.lit("")), F.coalesce(state["paletteCount"], F.lit(0)).cast("string"), weights, soft_text, colors)


def prune(entries: DataFrame, owner: str, cap: int) -> DataFrame:
    """entries(owner, ord, pinned, ...): all pinned ones, and the first cap others, with pos: pinned first, each in order."""
    cap = min(50, max(1, cap))
    rank = F.row_number().over(W.partitionBy(owner, "pinned").orderBy("ord"))
    kept = entries.withColumn("_rank", rank).filter(F.col("pinned") | (F.col("_rank") <= cap)).drop("_rank")
    return kept.withColumn("pos", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("pinned"), "ord")) - 1)


def update(entries: DataFrame, wanted: Column, pin: bool = False, name: Column | None = None) -> DataFrame:
    """Toggles the pin of the wanted entries, or renames them; a blank name clears."""
    out = entries
    if pin:
        out = out.withColumn("pinned", F.when(wanted, ~F.col("pinned")).otherwise(F.col("pinned")))
    if name is not None:
        out = out.withColumn("custom_name", F.when(wanted, F.when(F.trim(name) != "", F.trim(name))).otherwise(F.col("custom_name")))
    return out


def merge(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Both have key and ord. Imports with a new key, the first of each, come before what is there, pinned; origin tells which is which."""
    first = imported.groupBy("key").agg(F.min("ord").alias("ord"))
    new = first.join(existing.select("key"), "key", "left_anti").select("key", "ord", F.lit(True).alias("pinned"), F.lit("import").alias("origin"))
    return new.unionByName(existing.select("key", "ord", "pinned", F.lit("own").alias("origin")))


def merge_report(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """added and skipped: imported entries with a new key (the first of each), and all others."""
    first = imported.groupBy("key").agg(F.count("*").alias("n"))
    known = existing.select("key", F.lit(True).alias("known")).distinct()
    added = F.col("known").isNull().cast("long")
    return first.join(known, "key", "left").agg(F.coalesce(F.sum(added), F.lit(0)).alias("added"), F.coalesce(F.sum(F.col("n") - added), F.lit(0)).alias("skipped"))


def clear_unpinned(entries: DataFrame) -> DataFrame:
    """The pinned entries alone."""
    return entries.filter(F.coalesce("pinned", F.lit(False)))


def fresh_names(entries: DataFrame, current: DataFrame, key: str, name: str = "name") -> DataFrame:
    """entries with the current name of what they refer to, or the name they were stored with where it is gone."""
    now = current.select(key, F.col(name).alias("_now"))
    return entries.join(now, key, "left").withColumn(name, F.coalesce("_now", name)).drop("_now")


# The recipes that a new panel starts with.
STARTERS = [
    ("starter-1", "Punch — Contrast Lift", "contrast", [1.0, 1.0, 1.0, 1.0, 1.0], [(0, 0), (64, 48), (128, 128), (192, 208), (255, 255)]),
    ("starter-2", "Faded — Lifted Shadows", "color", [1.0, 1.0, 1.0, 1.0, 1.0], [(0, 24), (64, 70), (128, 130), (192, 200), (255, 248)]),
    ("starter-3", "Warm Midtones", "hue", [0.7, 1.0, 1.2, 1.2, 0.9], []),
    ("starter-4", "Mono — Contrast B&W", "contrast", [1.0, 1.0, 1.0, 1.0, 1.0], [(0, 0), (64, 40), (128, 128), (192, 220), (255, 255)]),
]


# The greys of the neutral palette that all starters share, each of a weight of a fifth.
NEUTRAL = [25, 70, 128, 185, 230]


def starters(spark: SparkSession) -> DataFrame:
    """The starters as whole entries: id, timestamp, label, name, pinned, signature, and state: source-only, so its target side is empty and no document is named. The envelope's points are in output values, not weights."""
    rows = [(i, n, p, w, [{"x": x, "y": y} for x, y in e] or None) for i, n, p, w, e in STARTERS]
    df = spark.createDataFrame(rows, "id string, name string, preset string, weights array<double>, points array<struct<x:int,y:int>>")
    grey = lambda g: F.struct(g.alias("r"), g.alias("g"), g.alias("b"), num(0.2).alias("weight"), (g / num(255) * num(100)).alias("labL"), num(0).alias("labA"), num(0).alias("labB"))
    swatches = F.transform(F.lit(NEUTRAL).cast("array<int>"), grey)
    none = F.array().cast("array<struct<r:int,g:int,b:int,weight:double,labL:double,labA:double,labB:double>>")
    parts = {
        "xmpVersion": F.lit(1),
        "toolVersion": F.lit("starter"),
        "preset": F.col("preset"),
        "outputMode": F.lit("rgb"),
        "colorSpace": F.lit("rgb"),
        "paletteCount": F.lit(len(NEUTRAL)),
        "sourcePaletteSwatches": swatches,
        "sourcePaletteWeights": F.col("weights"),
        "sourceSoftness": num(0),
        "targetPaletteSwatches": none,
        "targetPaletteWeights": F.array().cast("array<double>"),
        "targetSoftness": num(0),
        "selectionMode": F.lit("off"),
        "matchMode": F.lit("full"),
        "paletteAdaptive": F.lit(False),
        "envelope": F.col("points"),
        **{c: F.lit(None).cast("long") for c in IDS},
    }
    df = df.withColumn("state", F.struct(*[c.alias(n) for n, c in parts.items()]))
    colors = F.transform("state.sourcePaletteSwatches", lambda s: pack(s["r"], s["g"], s["b"]))
    hundredths = F.transform("weights", lambda w: half_up(w * num(100)))
    signature = F.struct(colors.alias("colors"), hundredths.alias("weights"))
    return df.select("id", F.lit(0).cast("long").alias("timestamp"), label(F.col("state")).alias("label"), "name", F.lit(True).alias("pinned"), "state", signature.alias("signature"))


def seed(owners: DataFrame, entries: DataFrame, owner: str) -> DataFrame:
    """The starters for every owner that has no entry: owner and the columns of starters()."""
    new = owners.select(owner).join(entries.select(owner), owner, "left_anti")
    return new.crossJoin(F.broadcast(starters(owners.sparkSession)))  # as many rows as there are starters


def restore(state: Column, full: bool) -> dict[str, Column]:
    """Panel settings of a state over their defaults; a recipe leaves the target's side alone."""
    mode = F.when(state["outputMode"].isin("rgb", "lab", "lut"), state["outputMode"]).when(state["colorSpace"].isin("rgb", "lab"), state["colorSpace"]).otherwise("lut")
    return {
        "preset": F.coalesce(state["preset"], F.lit("color")),
        "output_mode": mode,
        "palette_count": F.when(state["paletteCount"].isin(3, 5, 7), state["paletteCount"]).otherwise(5),
        "source_softness": F.coalesce(state["sourceSoftness"], num(0)),
        "target_softness": F.coalesce(state["targetSoftness"], num(0)) if full else num(0),
        "lut_strength": F.greatest(num(0), F.least(num(100), F.coalesce(state["lutStrength"], num(100)))),
        "lut_grid": F.when(state["lutGrid"].isin(17, 33, 65), state["lutGrid"]).otherwise(33),
        "selection_mode": F.when(state["selectionMode"].isin("off", "focus", "exclude"), state["selectionMode"]).otherwise("off") if full else F.lit("off"),
    }
