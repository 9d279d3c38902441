"""Queries of recipes, layer trees and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.color import num
from tessera.operators import admission as D
from tessera.operators import folds as H
from tessera.operators import layers as L
from tessera.operators import recipes as R
from tessera.operators import scans as C
from tessera.sources.fixtures import table
from tessera.streaming import events as E


def events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts"))


def users(s, d):
    """One recipe per user: n events, first event's ms."""
    return events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.min("ms").alias("ms"), F.sum((F.col("event_type") == "click").cast("int")).alias("clicks"))


PRESETS = ("color", "hue", "hueOnly", "saturationOnly", "contrast")


def state(df):
    """users with a state column."""
    u = F.col("user_id")
    st = F.struct(
        F.element_at(F.array(*map(F.lit, PRESETS)), (u % 5 + 1).cast("int")).alias("preset"),
        F.when(u % 4 == 0, F.lit(None).cast("string")).otherwise(F.element_at(F.array(F.lit("rgb"), F.lit("lab"), F.lit("lut")), (u % 3 + 1).cast("int"))).alias("outputMode"),
        F.when(u % 2 == 0, "lab").otherwise("").alias("colorSpace"),
        F.when(u % 7 != 0, (u % 4 * 2 + 1).cast("int")).alias("paletteCount"),
        F.array(F.col("clicks") / num(8), num(1), F.col("n") % 10 / num(4)).alias("sourcePaletteWeights"),
        F.when(u % 3 == 0, u / num(2)).alias("sourceSoftness"),
        F.array(F.struct((u % 256).cast("int").alias("r"), F.lit(7).alias("g"), (u * 3 % 256).cast("int").alias("b"), num(1).alias("weight"), num(0).alias("labL"), num(0).alias("labA"), num(0).alias("labB"))).alias("sourcePaletteSwatches"),
        (u % 50).cast("double").alias("targetSoftness"),
        (u * 2).cast("double").alias("lutStrength"),
        F.element_at(F.array(F.lit(17), F.lit(33), F.lit(40), F.lit(65)), (u % 4 + 1).cast("int")).alias("lutGrid"),
        F.when(u % 2 == 1, "focus").otherwise("both").alias("selectionMode"),
    )
    return df.withColumn("state", st)


def files(s, d):
    """A recipe file per user; by user number: cut off, wrong tag, too new, no entries, an entry without id, one with an empty state, or whole."""
    body = F.format_string('"label":"RGB","pinned":true,"state":{%s},"signature":{"colors":[1],"weights":[100]}}', F.when(F.col("user_id") % 7 == 5, "").otherwise('"preset":"hue","paletteCount":5'))
    entry = F.concat(F.when(F.col("user_id") % 7 == 4, '{"timestamp":5,').otherwise(F.format_string('{"id":"u%d","timestamp":%d,', "user_id", "ms")), body)
    whole = F.format_string('{"format":"%s","version":%d,"exportedAt":"2024-01-01","%s":[%s,%s]}', F.when(F.col("user_id") % 7 == 1, "other").otherwise("tessera-recipes"), F.when(F.col("user_id") % 7 == 2, 2).otherwise(1), F.when(F.col("user_id") % 7 == 3, "items").otherwise("entries"), entry, F.lit('{"id":"x","timestamp":1,"label":"L","state":{"preset":"color"},"signature":{"colors":[],"weights":[]}}'))
    return users(s, d).select("user_id", F.when(F.col("user_id") % 7 == 0, F.substring(whole, 1, 60)).otherwise(whole).alias("text"))


def recipe_parse(s, d):
    return R.parse(files(s, d)).select("user_id", "status", F.when(F.col("status") == "ok", F.size("entries")).alias("n"), F.array_join(F.transform("entries", lambda e: e["id"]), ",").alias("ids"))


def recipe_serialize(s, d):
    e = F.array(F.struct(F.format_string("u%d", "user_id").alias("id"), F.col("ms").alias("timestamp"), F.lit("L").alias("label"), F.lit(True).alias("pinned"), F.struct(F.lit("hue").alias("preset"), F.lit(9).alias("sourceDocId"), F.lit(8).alias("sourceLayerId"), F.lit(7).alias("targetDocId"), F.lit(6).alias("targetLayerId")).alias("state")))
    return users(s, d).select("user_id", R.serialize(e, "2024-01-01").alias("text"))


def xmp_roundtrip(s, d):
    json = F.format_string('{"name":"a<b>&amp;&lt; %d","n":%d}', "user_id", "n")
    df = users(s, d).select("user_id", json.alias("json")).withColumn("packet", R.packet(F.col("json")))
    return df.select("user_id", F.length("packet").alias("length"), R.packet_body(F.col("packet")).alias("body"), (R.packet_body(F.col("packet")) == F.col("json")).alias("same"))


def history(s, d):
    """Entries by events: signups are pinned; ord counts back from the newest."""
    e = events(s, d).select("user_id", F.col("event_id").alias("id"), "ms", F.col("event_type").alias("key"), (F.col("event_type") == "signup").alias("pinned"))
    return e


def history_topk(s, d):
    e = history(s, d).withColumn("ord", -F.col("id"))
    return R.prune(e, "user_id", 5).select("user_id", "pos", "id", "pinned")


def history_prune(s, d):
    parsed = R.parse(files(s, d)).select("user_id", F.posexplode("entries").alias("ord", "e"))
    return R.prune(parsed.select("user_id", "ord", F.coalesce("e.pinned", F.lit(False)).alias("pinned"), F.col("e.id").alias("id")), "user_id", 1).select("user_id", "pos", "id", "pinned")


def history_update(s, d):
    e = history(s, d).select("user_id", "id", "pinned", F.lit("old").alias("custom_name"))
    return R.update(e, F.col("id") % 10 == 3, True, F.when(F.col("id") % 20 == 3, "  ").otherwise(F.concat(F.lit(" n"), F.col("id").cast("string"), F.lit(" "))))


def recipe_merge(s, d):
    """Purchases are what is there, all other events what is imported; keys are of user and hour."""
    return R.merge(*merge_sides(s, d))


def merge_sides(s, d):
    e = events(s, d).select(F.col("event_id").alias("ord"), F.lit(False).alias("pinned"), F.col("event_type").alias("kind"), F.concat_ws("|", F.col("user_id").cast("string"), F.expr("ms div 3600000").cast("string")).alias("key"))
    return e.filter("kind = 'purchase'").drop("kind"), e.filter("kind <> 'purchase'").drop("kind")


def fresh(s, d):
    """Orders with the customers' names, some stored under an old name, some whose customer is gone."""
    stored = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") * F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1)).alias("c_custkey"), F.concat(F.lit("was "), F.col("o_custkey").cast("string")).alias("name"))
    return R.fresh_names(stored, table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey").select("o_orderkey", "name")


def paused(s, d):
    """Events wait while an error has paused their user; a signup lets them go on."""
    e = events(s, d).select("user_id", F.col("event_id").alias("id"), "ms", F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "resume").otherwise("event").alias("act"))
    return E.flush_pauses(e)


def inflight(s, d):
    """Work of one to five hours, by the event's value; events that come while their user's work goes on are dropped."""
    busy = (F.floor(F.col("value")).cast("long") % 5 + 1) * 3_600_000
    return D.guard(events(s, d).select("user_id", F.col("event_id").alias("id"), "ms", busy.alias("busy_ms"))).select("user_id", "id", "ms")


def undo_actions(s, d):
    act = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("change")
    return events(s, d).select("user_id", F.col("event_id").alias("id"), "ms", act.alias("act"), F.concat_ws("", "event_type", (F.col("event_id") % 2).cast("string")).alias("state"))


def state_query(s, d):
    df = state(users(s, d))
    full = R.restore(df["state"], True)
    recipe = R.restore(df["state"], False)
    return df.select("user_id", *[c.alias(n) for n, c in full.items()], recipe["target_softness"].alias("recipe_target_softness"), recipe["selection_mode"].alias("recipe_selection_mode"))


def starters(s, d):
    """For customers without an urgent order, as owners without a history."""
    entries = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    df = R.seed(table(s, d, "customer").select(F.col("c_custkey").alias("k")), entries, "k")
    sig = [F.array_join(F.transform(f"signature.{c}", lambda x: x.cast("string")), ",").alias(f"sig_{c}") for c in ("colors", "weights")]
    light = F.array_join(F.transform("state.sourcePaletteSwatches", lambda w: F.format_string("%.4f", w["labL"])), ",").alias("lights")
    weights = F.array_join(F.transform("state.sourcePaletteWeights", lambda w: F.format_string("%.1f", w)), ",").alias("weights")
    points = F.array_join(F.transform("state.envelope", lambda p: F.format_string("%d:%d", p["x"], p["y"])), ",").alias("points")
    target = F.concat_ws("|", F.size("state.targetPaletteSwatches").cast("string"), F.format_string("%.1f", "state.targetSoftness"), "state.selectionMode", "state.matchMode").alias("target")
    return df.select("k", "timestamp", "label", "pinned", F.col("state.outputMode").alias("output_mode"), *sig, light, "id", "name", "state.preset", weights, points, target)


def layers(s, d):
    """Regions as groups, nations as groups in them, customers as layers in those."""
    none = F.lit(None).cast("long")
    r = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("layer_id"), none.alias("parent_id"), F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("name"), F.lit("group").alias("kind"), F.lit(True).alias("visible"))
    n = table(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("long"), F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("int"), F.when(F.col("n_nationkey") % 5 == 0, "Match").otherwise(F.col("n_name")), F.lit("group"), F.lit(True))
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("Match RGB "), k.cast("string"))).when(k % 6 == 1, F.concat(F.lit("Match Lab "), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("Match LUT "), k.cast("string"))).when(k % 6 == 3, F.concat(F.lit("Match _"), (k % 37).cast("string"))).otherwise(F.col("c_name"))
    kind = F.when(k % 3 == 0, "pixel").when(k % 3 == 1, "text")
    c = table(s, d, "customer").select((k + 100000).cast("long"), (F.col("c_nationkey") + 1000).cast("long"), k.cast("int"), name, kind, k % 2 == 0)
    return r.union(n).union(c)


QUERIES = {
    "recipe_parse": recipe_parse,
    "recipe_serialize": recipe_serialize,
    "xmp_roundtrip": xmp_roundtrip,
    "history_label": lambda s, d: state(users(s, d)).select("user_id", R.label(F.col("state")).alias("label")),
    "dedup_key": lambda s, d: state(users(s, d)).select("user_id", R.dedup_key(F.col("state")).alias("key")),
    "history_push": lambda s, d: H.push_history(history(s, d), within=86_400_000),
    "history_topk": history_topk,
    "history_prune": history_prune,
    "history_update": history_update,
    "recipe_merge": recipe_merge,
    "merge_report": lambda s, d: R.merge_report(*merge_sides(s, d)),
    "clear_unpinned": lambda s, d: R.clear_unpinned(history(s, d)).select("user_id", "id"),
    "fresh_names": fresh,
    "pause_flush": paused,
    "undo_fold": lambda s, d: H.undo_fold(undo_actions(s, d)),
    "undo_scan": lambda s, d: C.undo_scan(undo_actions(s, d)),
    "state_restore": state_query,
    "starter_recipes": starters,
    "b64": lambda s, d: table(s, d, "events").select("event_id", F.base64(F.encode(F.concat(F.lit("é "), F.col("props")), "UTF-8")).alias("b64")),
    "layer_paths": lambda s, d: L.paths(layers(s, d), F.col("name") == "Match"),
    "group_consolidate": lambda s, d: L.consolidate(layers(s, d), F.col("name") == "Match"),
    "branch_number": lambda s, d: L.next_branch(layers(s, d), "Match"),
    "branch_layers": lambda s, d: L.branch(layers(s, d), "Match").select("layer_id", "name", "visible"),
    "layer_first": lambda s, d: L.first_of(layers(s, d), F.col("name").startswith("Match LUT")),
    "layer_visibility": lambda s, d: L.visibility(layers(s, d), F.col("name") == "Match", "lab"),
    "layer_prefix": lambda s, d: layers(s, d).filter(F.col("name").startswith("Match LUT")).select("layer_id", "name"),
    "layer_isolate": lambda s, d: L.isolate(layers(s, d), 100007),
    "debounce_sessions": lambda s, d: E.debounce(events(s, d), "6 hours").select("user_id", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "n"),
    "throttle_windows": lambda s, d: D.throttle(events(s, d).select("user_id", F.col("event_id").alias("id"), "ms", "value"), 21_600_000),
    "inflight_guard": inflight,
    "change_detect": lambda s, d: E.changes(events(s, d), "event_type").select("user_id", "event_id", "event_type"),
    "latest_wins": lambda s, d: E.latest(events(s, d), "value", "event_id"),
    "echo_suppress": lambda s, d: E.without_echo(events(s, d), "event_type = 'purchase'", "5 hours").select("user_id", "event_id"),
}
EV = "ev AS (SELECT *, epoch_us(ts)//1000 ms FROM events)"
US = f"{EV}, us AS (SELECT user_id, count(*) n, min(ms) ms, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) clicks FROM ev GROUP BY 1)"
ST = f"""{US}, st AS (SELECT user_id, ['color','hue','hueOnly','saturationOnly','contrast'][user_id % 5 + 1] preset, CASE WHEN user_id % 4 <> 0 THEN ['rgb','lab','lut'][user_id % 3 + 1] END om, CASE WHEN user_id % 2 = 0 THEN 'lab' ELSE '' END cs,
 CASE WHEN user_id % 7 <> 0 THEN user_id % 4 * 2 + 1 END pc, [clicks/8e0, 1e0, (n % 10)/4e0] ws, CASE WHEN user_id % 3 = 0 THEN user_id/2e0 END ss FROM us), md AS (SELECT *, coalesce(om, nullif(cs, ''), 'rgb') mode FROM st)"""
HIST = f"{EV}, hs AS (SELECT user_id, event_id id, ms, event_type k, event_type = 'signup' p, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) rn FROM ev)"
LAY = """ly AS (SELECT CAST(r_regionkey AS BIGINT) layer_id, CAST(NULL AS BIGINT) parent_id, CAST(r_regionkey AS INT) ord, r_name "name", 'group' kind, true visible FROM region
UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'Match' ELSE n_name END, 'group', true FROM nation
UNION ALL SELECT c_custkey + 100000, c_nationkey + 1000, c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Match RGB ' || c_custkey WHEN 1 THEN 'Match Lab ' || c_custkey WHEN 2 THEN 'Match LUT ' || c_custkey WHEN 3 THEN 'Match _' || (c_custkey % 37) ELSE c_name END, CASE c_custkey % 3 WHEN 0 THEN 'pixel' WHEN 1 THEN 'text' END, c_custkey % 2 = 0 FROM customer)"""
ROWS = "row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) rn"
SQL = {
    "recipe_parse": f"""WITH {US} SELECT user_id, CASE user_id % 7 WHEN 0 THEN 'json' WHEN 1 THEN 'tag' WHEN 2 THEN 'version' WHEN 3 THEN 'entries' ELSE 'ok' END status, CAST(CASE WHEN user_id % 7 IN (4, 5) THEN 1 WHEN user_id % 7 = 6 THEN 2 END AS INT) n,
CASE WHEN user_id % 7 IN (4, 5) THEN 'x' WHEN user_id % 7 = 6 THEN 'u' || user_id || ',x' END ids FROM us""",
    "recipe_serialize": f"""WITH {US} SELECT user_id, '{{"format":"tessera-recipes","version":1,"exportedAt":"2024-01-01","entries":[{{"id":"u' || user_id || '","timestamp":' || ms || ',"label":"L","state":{{"preset":"hue"}}}}]}}' "text" FROM us""",
    "xmp_roundtrip": f"""WITH {US}, j AS (SELECT user_id, format('{{{{"name":"a<b>&amp;&lt; {{}}","n":{{}}}}}}', user_id, n) body FROM us) SELECT user_id, CAST(length(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + {len('<x:xmpmeta xmlns:x="adobe:ns:meta/">' + chr(10) + ' <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">' + chr(10) + '  <rdf:Description rdf:about="" xmlns:t="urn:tessera">' + chr(10) + '   <t:State>' + '</t:State>' + chr(10) + '  </rdf:Description>' + chr(10) + ' </rdf:RDF>' + chr(10) + '</x:xmpmeta>')} AS INT) "length", body, true same FROM j""",
    "history_label": f"WITH {ST} SELECT user_id, upper(mode) || ' · ' || upper(preset[1]) || lower(preset[2:]) || ' · ' || coalesce(pc, 1) || ' swatches' \"label\" FROM md",
    "dedup_key": f"WITH {ST} SELECT user_id, mode || '|' || preset || '|' || coalesce(pc, 0) || '|' || array_to_string(list_transform(ws, lambda w: CAST(floor(w*1000 + 5e-1) AS BIGINT)), ',') || '|' || CASE WHEN coalesce(ss, 0) = floor(coalesce(ss, 0)) THEN CAST(CAST(coalesce(ss, 0) AS BIGINT) AS VARCHAR) ELSE CAST(ss AS VARCHAR) END || '|' || (user_id % 256) || ',7,' || (user_id*3 % 256) \"key\" FROM md",
    "history_push": f"""WITH RECURSIVE {HIST}, f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(id BIGINT, ms BIGINT, k VARCHAR, p BOOLEAN)[]) h FROM hs
UNION ALL SELECT f.user_id, f.rn + 1, CASE WHEN coalesce(hs.ms - list_filter(h, lambda x: NOT x.p)[1].ms < 86400000 AND list_filter(h, lambda x: NOT x.p)[1].k = hs.k, false) THEN h
 ELSE list_concat(list_filter(list_prepend({{'id': hs.id, 'ms': hs.ms, 'k': hs.k, 'p': hs.p}}, h), lambda x: x.p), list_filter(list_prepend({{'id': hs.id, 'ms': hs.ms, 'k': hs.k, 'p': hs.p}}, h), lambda x: NOT x.p)[1:5]) END
 FROM f JOIN hs ON hs.user_id = f.user_id AND hs.rn = f.rn + 1), l AS (SELECT user_id, arg_max(h, rn) h FROM f GROUP BY 1) SELECT user_id, CAST(i - 1 AS INT) pos, h[i].id id FROM l, LATERAL (SELECT unnest(range(1, len(h) + 1)) i)""",
    "history_topk": f"WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, p ORDER BY id DESC) k2 FROM hs) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY p DESC, id DESC) - 1 AS INT) pos, id, p pinned FROM r WHERE p OR k2 <= 5",
    "history_prune": f"WITH {US} SELECT user_id, CAST(0 AS INT) pos, 'x' id, false pinned FROM us WHERE user_id % 7 IN (4, 5) UNION ALL SELECT user_id, 0, 'u' || user_id, true FROM us WHERE user_id % 7 = 6 UNION ALL SELECT user_id, 1, 'x', false FROM us WHERE user_id % 7 = 6",
    "history_update": f"WITH {HIST} SELECT user_id, id, CASE WHEN id % 10 = 3 THEN NOT p ELSE p END pinned, CASE WHEN id % 20 = 3 THEN NULL WHEN id % 10 = 3 THEN 'n' || id ELSE 'old' END custom_name FROM hs",
    "recipe_merge": f"""WITH {EV}, e AS (SELECT user_id || '|' || (ms // 3600000) "key", event_id ord, event_type k FROM ev), o AS (SELECT * FROM e WHERE k = 'purchase')
SELECT "key", min(ord) ord, true pinned, 'import' origin FROM e WHERE k <> 'purchase' AND "key" NOT IN (SELECT "key" FROM o) GROUP BY 1 UNION ALL SELECT "key", ord, false, 'own' FROM o""",
    "merge_report": f"""WITH {EV}, e AS (SELECT user_id || '|' || (ms // 3600000) "key", event_type k FROM ev), o AS (SELECT DISTINCT "key" FROM e WHERE k = 'purchase'), i AS (SELECT "key", count(*) n, "key" IN (SELECT "key" FROM o) old FROM e WHERE k <> 'purchase' GROUP BY 1)
SELECT CAST(count(*) FILTER (NOT old) AS BIGINT) added, CAST(sum(CASE WHEN old THEN n ELSE n - 1 END) AS BIGINT) skipped FROM i""",
    "clear_unpinned": "SELECT user_id, event_id id FROM events WHERE event_type = 'signup'",
    "fresh_names": "SELECT o_orderkey, coalesce(c_name, 'was ' || o_custkey) \"name\" FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END",
    "pause_flush": f"""WITH {EV}, e AS (SELECT user_id, event_id id, ms, event_type k FROM ev), r AS (SELECT *, max(CASE WHEN k IN ('error', 'signup') THEN (ms, id, k) END) OVER (PARTITION BY user_id ORDER BY ms, id) s,
 min(CASE WHEN k = 'signup' THEN (ms, id) END) OVER (PARTITION BY user_id ORDER BY ms, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nx FROM e)
SELECT user_id, id, CASE WHEN coalesce(s[3] = 'error', false) THEN nx[1] ELSE ms END at_ms FROM r WHERE k NOT IN ('error', 'signup')""",
    "undo_fold": f"""WITH RECURSIVE {EV}, ac AS (SELECT user_id, {ROWS}, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'change' END act, event_type || (event_id % 2) s FROM ev),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) rn, CAST(NULL AS VARCHAR) cur, CAST([] AS VARCHAR[]) past, CAST([] AS VARCHAR[]) fut FROM ac
UNION ALL SELECT f.user_id, f.rn + 1,
 CASE WHEN act = 'change' THEN s WHEN act = 'undo' AND len(past) > 0 THEN past[-1] WHEN act = 'redo' AND len(fut) > 0 THEN fut[-1] ELSE cur END,
 CASE WHEN act = 'change' AND s IS DISTINCT FROM cur AND cur IS NOT NULL THEN list_append(past, cur)[-30:] WHEN act = 'undo' AND len(past) > 0 THEN past[:-2] WHEN act = 'redo' AND len(fut) > 0 THEN list_append(past, cur)[-30:] ELSE past END,
 CASE WHEN act = 'change' AND s IS DISTINCT FROM cur THEN [] WHEN act = 'undo' AND len(past) > 0 THEN list_append(fut, cur)[-30:] WHEN act = 'redo' AND len(fut) > 0 THEN fut[:-2] ELSE fut END
 FROM f JOIN ac ON ac.user_id = f.user_id AND ac.rn = f.rn + 1), l AS (SELECT user_id, arg_max(cur, rn) FILTER (cur IS NOT NULL) cur, arg_max(len(past), rn) pd, arg_max(len(fut), rn) fd FROM f GROUP BY 1)
SELECT user_id, cur present, CAST(pd AS INT) undo_depth, CAST(fd AS INT) redo_depth FROM l""",
    "state_restore": f"""WITH {ST} SELECT user_id, preset, CASE WHEN om IS NOT NULL THEN om WHEN cs = 'lab' THEN cs ELSE 'lut' END output_mode, CAST(CASE WHEN pc IN (3, 5, 7) THEN pc ELSE 5 END AS INT) palette_count, coalesce(ss, 0e0) source_softness, CAST(user_id % 50 AS DOUBLE) target_softness,
least(100e0, user_id*2e0) lut_strength, CASE user_id % 4 WHEN 0 THEN 17 WHEN 3 THEN 65 ELSE 33 END lut_grid, CASE WHEN user_id % 2 = 1 THEN 'focus' ELSE 'off' END selection_mode, 0e0 recipe_target_softness, 'off' recipe_selection_mode FROM md""",
    "starter_recipes": """WITH v AS (SELECT * FROM (VALUES ('starter-1', 'Punch — Contrast Lift', 'contrast', '1.0,1.0,1.0,1.0,1.0', '0:0,64:48,128:128,192:208,255:255'), ('starter-2', 'Faded — Lifted Shadows', 'color', '1.0,1.0,1.0,1.0,1.0', '0:24,64:70,128:130,192:200,255:248'), ('starter-3', 'Warm Midtones', 'hue', '0.7,1.0,1.2,1.2,0.9', NULL), ('starter-4', 'Mono — Contrast B&W', 'contrast', '1.0,1.0,1.0,1.0,1.0', '0:0,64:40,128:128,192:220,255:255')) t(id, "name", preset, weights, points))
SELECT c_custkey k, '0|0.0|off|full' target, CAST(0 AS BIGINT) "timestamp", 'RGB · ' || upper(preset[1]) || preset[2:] || ' · 5 swatches' "label", true pinned, 'rgb' output_mode, '1644825,4605510,8421504,12171705,15132390' sig_colors,
 array_to_string(list_transform(string_split(weights, ','), lambda w: CAST(round(CAST(w AS DOUBLE)*100) AS INT)), ',') sig_weights, '9.8039,27.4510,50.1961,72.5490,90.1961' lights, v.* FROM v, customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "b64": "SELECT event_id, to_base64(encode('é ' || props)) b64 FROM events",
    "layer_paths": f"WITH RECURSIVE {LAY}, w AS (SELECT layer_id, kind, \"name\" path FROM ly WHERE parent_id IS NULL AND \"name\" <> 'Match' UNION ALL SELECT ly.layer_id, ly.kind, w.path || ' / ' || ly.\"name\" FROM w JOIN ly ON ly.parent_id = w.layer_id WHERE ly.\"name\" <> 'Match') SELECT layer_id, path FROM w WHERE kind IN ('pixel', 'smartObject') OR kind IS NULL",
    "group_consolidate": f"WITH {LAY}, g AS (SELECT layer_id, parent_id, ord FROM ly WHERE \"name\" = 'Match' AND kind = 'group'), c AS (SELECT arg_min(layer_id, (parent_id, ord)) k FROM g) SELECT layer_id, CASE WHEN parent_id IN (SELECT layer_id FROM g) THEN k ELSE parent_id END parent_id, \"name\" FROM ly, c WHERE layer_id NOT IN (SELECT layer_id FROM g) OR layer_id = k",
    "branch_number": f"WITH {LAY} SELECT max(TRY_CAST(regexp_extract(\"name\", '^Match _(\\d+)', 1) AS INT)) + 1 n, 'Match _' || format('{{:02d}}', max(TRY_CAST(regexp_extract(\"name\", '^Match _(\\d+)', 1) AS INT)) + 1) \"name\" FROM ly",
    "branch_layers": f"""WITH RECURSIVE {LAY}, t AS (SELECT layer_id, "name", kind, [ord] pl FROM ly WHERE parent_id IS NULL UNION ALL SELECT ly.layer_id, ly."name", ly.kind, list_append(pl, ly.ord) FROM t JOIN ly ON ly.parent_id = t.layer_id),
g AS (SELECT arg_min(layer_id, pl) g FROM t WHERE "name" = 'Match' AND kind = 'group'), x AS (SELECT max(TRY_CAST(regexp_extract("name", '^Match _(\\d+)', 1) AS INT)) + 1 n FROM ly)
SELECT layer_id, CASE WHEN layer_id = g THEN 'Match _' || format('{{:02d}}', n) ELSE "name" END "name", CASE WHEN layer_id = g THEN false ELSE visible END visible FROM ly, g, x""",
    "layer_first": f"""WITH RECURSIVE {LAY}, t AS (SELECT layer_id, "name", [ord] pl FROM ly WHERE parent_id IS NULL UNION ALL SELECT ly.layer_id, ly."name", list_append(pl, ly.ord) FROM t JOIN ly ON ly.parent_id = t.layer_id) SELECT arg_min(layer_id, pl) layer_id FROM t WHERE "name" LIKE 'Match LUT%'""",
    "layer_visibility": f"""WITH RECURSIVE {LAY}, t AS (SELECT layer_id, "name", kind, [ord] pl, [layer_id] up FROM ly WHERE parent_id IS NULL UNION ALL SELECT ly.layer_id, ly."name", ly.kind, list_append(pl, ly.ord), list_append(up, ly.layer_id) FROM t JOIN ly ON ly.parent_id = t.layer_id),
g AS (SELECT arg_min(layer_id, pl) g FROM t WHERE "name" = 'Match' AND kind = 'group'), b AS (SELECT layer_id FROM t, g WHERE list_contains(up, g) AND layer_id <> g)
SELECT layer_id, CASE WHEN layer_id NOT IN (SELECT layer_id FROM b) THEN visible WHEN starts_with("name", 'Match Lab') THEN true WHEN regexp_matches("name", '^Match (RGB|Curves|LUT)') THEN false ELSE visible END visible FROM ly""",
    "layer_prefix": f"WITH {LAY} SELECT layer_id, \"name\" FROM ly WHERE \"name\" LIKE 'Match LUT%'",
    "layer_isolate": f"WITH RECURSIVE {LAY}, u AS (SELECT layer_id, parent_id FROM ly WHERE layer_id = 100007 UNION ALL SELECT ly.layer_id, ly.parent_id FROM u JOIN ly ON ly.layer_id = u.parent_id) SELECT layer_id, layer_id IN (SELECT layer_id FROM u) visible FROM ly",
    "debounce_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) s FROM e) SELECT user_id, epoch_us(min(ts))//1000 first_ms, epoch_us(max(ts))//1000 last_ms, count(*) n FROM g GROUP BY user_id, s",
    "throttle_windows": f"WITH RECURSIVE {EV}, e AS (SELECT user_id, event_id, ms, value, {ROWS} FROM ev), f AS (SELECT user_id, rn, ms, ms o, value FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.ms, CASE WHEN e.ms - f.o >= 21600000 THEN e.ms ELSE f.o END, e.value FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT user_id, o open_ms, o + 21600000 fire_ms, CAST(count(*) AS INT) n, arg_max(value, rn) \"last\" FROM f GROUP BY 1, 2",
    "inflight_guard": f"""WITH RECURSIVE {EV}, e AS (SELECT user_id, event_id id, ms, (CAST(floor(value) AS BIGINT) % 5 + 1)*3600000 busy, {ROWS} FROM ev),
f AS (SELECT user_id, rn, id, ms, ms + busy free, true taken FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.id, e.ms, CASE WHEN e.ms >= f.free THEN e.ms + e.busy ELSE f.free END, e.ms >= f.free FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT user_id, id, ms FROM f WHERE taken""",
    "change_detect": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) WHERE b IS NULL OR b <> event_type",
    "latest_wins": "SELECT user_id, arg_max(value, event_id) \"value\", max(event_id) event_id FROM events GROUP BY 1",
    "echo_suppress": "SELECT user_id, event_id FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM events w WHERE w.user_id = e.user_id AND w.event_type = 'purchase' AND w.ts <= e.ts AND e.ts < w.ts + INTERVAL 5 HOURS)",
}
SQL["undo_scan"] = SQL["undo_fold"]
