"""Queries of stores and streams: tables that are updated, reused or grow, each made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.distances import DistanceStore
from tessera.operators.raster import full_mask
from tessera.sources import keyed as K
from tessera.sources import settings as S
from tessera.sources.fixtures import source_pixels as src
from tessera.sources.fixtures import table
from tessera.sources.fixtures import target_pixels as tgt
from tessera.streaming import fits as T
from tessera.streaming import state as L

from .documents import EV, ST, events, state, users
from .documents import SQL as DOCUMENTS
from .palettes import DIST, LABS, SOFT, _soft
from .spatial import new_folder
from .sqltext import BOTH, SPECIFY, TGT

MIX = [0.25, 1.5, 0.75]
KEY_BUCKETS = 16


def layer_upsert(s, d):
    """Customers' balances, updated from the urgent orders: also from some of customers that are not stored, which change nothing."""
    path = new_folder(s, "layers")
    K.write_keyed(table(s, d, "customer").select(F.col("c_custkey").alias("layer_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"), F.lit(0).alias("version")), path, "layer_id", KEY_BUCKETS)
    urgent = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'")
    keys = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    K.upsert(s, path, urgent.groupBy(keys.alias("layer_id")).agg(F.max("o_totalprice").alias("value"), F.count("*").cast("int").alias("version")), "layer_id", KEY_BUCKETS)
    return K.read_keyed(s, path)


def weights_reuse(s, d):
    """A second setting of weights on distances that a first one has stored."""
    px, store = tgt(s, d), DistanceStore(s, new_folder(s, "distances"))
    store.distances(px, LABS)
    return store.weights(px, LABS, MIX, SOFT).select("px_id", F.round("ew", 6).alias("ew"))


def settings_versions(s, d):
    """Two versions of all users' settings; the second is read."""
    path, df = new_folder(s, "settings"), state(users(s, d)).select(F.format_string("u%d", "user_id").alias("name"), F.col("ms").alias("saved_ms"), F.to_json("state").alias("state"))
    S.save_settings(df.withColumn("saved_ms", F.lit(0).cast("long")), path)
    S.save_settings(df, path)
    return S.load_settings(s, path).select("name", "saved_ms", F.col("state.preset").alias("preset"), F.col("state.paletteCount").alias("palette_count"))


def hist_stream(s, d):
    """Target pixels arrive in four parts, and those with g divisible by 5 go again; the curves are the last version's."""
    path = new_folder(s, "growing")
    px = tgt(s, d).select("px_id", *"rgba", F.lit(1).alias("sign"))
    px, parts = px.drop("px_id"), px.repartition(4, "px_id").drop("px_id")  # by a key: rows dealt in turn are sorted first
    parts.write.parquet(f"{path}/in")
    px.filter("g % 5 = 0").withColumn("sign", F.lit(-1)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = s.readStream.schema(px.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    T.fit_stream(src(s, d), stream, f"{path}/fits", f"{path}/checkpoint").awaitTermination()
    return T.latest_fit(s, f"{path}/fits")


PARTS = 3


def _streamed(s, rows, name, made):
    """The output of a stream over rows, which come in PARTS parts that follow one another in time, read by a query that is stopped after the first and started again.

    A part is a file a core, dealt by user: as all of a user's rows of a part are in one file, and files are taken by age, each user's come in order however files fall into micro-batches."""
    path, files = new_folder(s, name), s.sparkContext.defaultParallelism
    first, last = rows.agg(F.min("ms"), F.max("ms")).first()
    width = (last - first) // PARTS + 1
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(provider, None)
    L.streams(s)
    try:
        for k in range(PARTS):
            part = rows.filter(F.col("ms").between(first + k * width, first + (k + 1) * width - 1))
            part.repartition(files, "user_id").write.mode("append").parquet(f"{path}/in")
            if k != 1:  # the second query meets two parts
                stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
                q = made(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
                q.awaitTermination()
    finally:
        s.conf.set(provider, before) if before else s.conf.unset(provider)
    return s.read.parquet(f"{path}/out")


def pause_stream(s, d):
    act = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "resume").otherwise("event")
    return _streamed(s, events(s, d).select("user_id", F.col("event_id").alias("id"), "ms", act.alias("act")), "pauses", L.flush_pauses)


def history_stream(s, d):
    rows = events(s, d).select("user_id", F.col("event_id").alias("id"), "ms", F.col("event_type").alias("key"), (F.col("event_type") == "signup").alias("pinned"))
    out = _streamed(s, rows, "history", lambda df: L.push_history(df, within=86_400_000))
    last = out.groupBy("user_id").agg(F.max("upto").alias("upto"))
    return out.join(last, ["user_id", "upto"]).select("user_id", "pos", F.col("entry").alias("id"))


QUERIES = {
    "layer_upsert": layer_upsert,
    "weights_reuse": weights_reuse,
    "settings_versions": settings_versions,
    "hist_stream": hist_stream,
    "pause_stream": pause_stream,
    "history_stream": history_stream,
    "mask_full": lambda s, d: full_mask(tgt(s, d)),
}

_mix = "CASE k " + " ".join(f"WHEN {k} THEN {w!r}::DOUBLE" for k, w in enumerate(MIX)) + " END"
SQL = {
    "layer_upsert": """WITH u AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END k, max(o_totalprice) v, CAST(count(*) AS INT) n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey layer_id, c_name "name", coalesce(v, c_acctbal) "value", coalesce(n, 0) "version" FROM customer LEFT JOIN u ON k = c_custkey""",
    "weights_reuse": f"WITH {DIST}, {_soft(_mix, 'sw')} SELECT t.px_id, round(coalesce(s.w, 0), 6) ew FROM tgt t LEFT JOIN sw s USING (px_id)".replace("SELECT px_id, w, 1e0/", "SELECT px_id, k, 1e0/"),
    "settings_versions": f"WITH {ST} SELECT 'u' || user_id \"name\", ms saved_ms, preset, CAST(pc AS INT) palette_count FROM st JOIN us USING (user_id)",
    "hist_stream": f"WITH {BOTH.replace(TGT, TGT.replace('tgt AS', 'tgt0 AS', 1) + ', tgt AS (SELECT * FROM tgt0 WHERE g % 5 <> 0)')}, {SPECIFY} SELECT ch, v, o \"out\" FROM curves",
    "history_stream": DOCUMENTS["history_push"],
    "pause_stream": f"""WITH {EV}, e AS (SELECT user_id, event_id id, ms, event_type k FROM ev), r AS (SELECT *, max(CASE WHEN k IN ('error', 'signup') THEN (ms, id, k) END) OVER (PARTITION BY user_id ORDER BY ms, id) s,
 min(CASE WHEN k = 'signup' THEN (ms, id) END) OVER (PARTITION BY user_id ORDER BY ms, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nx FROM e)
SELECT * FROM (SELECT user_id, id, CASE WHEN coalesce(s[3] = 'error', false) THEN nx[1] ELSE ms END at_ms FROM r WHERE k NOT IN ('error', 'signup')) WHERE at_ms IS NOT NULL""",
    "mask_full": f"WITH {TGT} SELECT px_id, 255 m FROM tgt",
}
