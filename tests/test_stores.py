import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import dist as D
from tessera.operators import palette as A
from tessera.operators.distances import DistanceStore, version_of
from tessera.sources import keyed as K
from tessera.sources import settings as S
from tessera.streaming import fits as T


def px_of(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("px_id"), *[(F.col("id") * p % 256).cast("int").alias(c) for c, p in (("r", 7), ("g", 31), ("b", 101))], F.when(F.col("id") % 11 == 0, 5).otherwise(255).alias("a"))


def test_fits_of_a_stream_are_those_of_all_so_far(spark, tmp_path):
    px = px_of(spark)
    source = px.withColumn("r", F.col("r") * F.col("r") % 256)
    schema = px.withColumn("sign", F.lit(1)).schema
    sofar = None
    for k, part in enumerate([px.filter("px_id < 900"), px.filter("px_id >= 900"), px.filter("px_id % 3 = 0")]):
        part.withColumn("sign", F.lit(-1 if k == 2 else 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        assert T.fit_stream(source, stream, f"{tmp_path}/fits", f"{tmp_path}/cp").awaitTermination(120)
        sofar = part if sofar is None else sofar.exceptAll(part) if k == 2 else sofar.unionByName(part)
        got = T.latest_fit(spark, f"{tmp_path}/fits")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.fit_full(source, sofar).collect()))
    assert spark.read.parquet(f"{tmp_path}/fits").select("version").distinct().count() == 3


def test_renewed_curves_are_not_made_in_one_task(spark, tmp_path):
    """To coalesce the curves ran the windows of all partitions in one task, and that held the memory of all."""
    px = px_of(spark).withColumn("sign", F.lit(1))
    px.write.parquet(f"{tmp_path}/in")
    done = spark._jsparkSession.sharedState().statusStore().executionsList
    before = done().size()
    assert T.fit_stream(px, spark.readStream.schema(px.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/fits", f"{tmp_path}/cp").awaitTermination(120)
    plans = [done().apply(i).physicalPlanDescription() for i in range(before, done().size())]
    assert any("Window" in p for p in plans) and not any("Coalesce" in p for p in plans)
    assert len(list(tmp_path.glob("fits/version=0/*.parquet"))) == 1


def files(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.glob("bucket=*/*.parquet")}


def test_upserts_write_only_what_they_meet(spark, tmp_path):
    path = tmp_path / "t"
    K.write_keyed(spark.range(200).select("id", F.lit("old").alias("name"), (F.col("id") * 2).alias("v")), str(path), "id", 16)
    before = files(path)
    up = spark.createDataFrame([(3, "new"), (77, None), (-5, "none")], "id long, name string")
    n = K.upsert(spark, str(path), up, "id", 16)
    after = files(path)
    changed = {p.parts[0] for p in set(before) ^ set(after)}
    assert n == len(changed) <= 2 and all(after[p] == t for p, t in before.items() if p.parts[0] not in changed)
    rows = {r["id"]: (r["name"], r["v"]) for r in K.read_keyed(spark, str(path)).collect()}
    assert rows == {i: ("new" if i == 3 else None if i == 77 else "old", 2 * i) for i in range(200)}
    assert K.upsert(spark, str(path), up.filter("id < 0"), "id", 16) == 0 and files(path) == after
    K.upsert(spark, str(path), up, "id", 16, insert=True)
    assert K.read_keyed(spark, str(path)).filter("id = -5").first()[1:] == ("none", None) and K.read_keyed(spark, str(path)).count() == 201
    with pytest.raises(ValueError, match="repeat"):
        K.upsert(spark, str(path), up.union(up), "id", 16)
    with pytest.raises(ValueError, match="no x"):
        K.upsert(spark, str(path), up.withColumnRenamed("name", "x"), "id", 16)


def test_a_second_weight_setting_reads_no_colours(spark, tmp_path):
    px_of(spark).write.parquet(f"{tmp_path}/px")
    px, clusters = spark.read.parquet(f"{tmp_path}/px"), [(20.0, 10.0, -30.0), (70.0, -5.0, 9.0)]
    store = DistanceStore(spark, f"{tmp_path}/store")
    store.weights(px, clusters, [1.0, 0.5], 30).count()
    assert len(list(tmp_path.glob("store/*"))) == 1
    second = store.weights(px, clusters, [0.25, 2.0], 60)
    assert len(list(tmp_path.glob("store/*"))) == 1
    plan = second._jdf.queryExecution().toString()
    assert "ReadSchema: struct<px_id:bigint,d:array<double>>" in plan and "/px]" not in plan
    want = A.with_distances(px, clusters).select("px_id", A.effective_weight([0.25, 2.0], 60).alias("ew"))
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, want.collect()))
    store.weights(px, clusters[:1], [1.0]).count()
    before = version_of(px)
    px_of(spark, 10).write.mode("append").parquet(f"{tmp_path}/px")
    grown = spark.read.parquet(f"{tmp_path}/px")
    assert version_of(grown) != before and version_of(px.filter("a > 9")) != before
    assert store.weights(grown, clusters, [1.0, 1.0]).count() == 3010
    assert store.forget([store.place(version_of(grown), clusters)]) == 2 and len(list(tmp_path.glob("store/*"))) == 1


def test_settings_show_one_version_at_a_time(spark, tmp_path):
    path = f"{tmp_path}/s"
    row = lambda name, ms, preset: (name, ms, json.dumps({"preset": preset, "sourceSoftness": 2.5}))
    schema = "name string, saved_ms long, state string"
    S.save_settings(spark.createDataFrame([row("a", 1, "hue"), row("b", 2, "color")], schema).repartition(2), path)
    read = S.load_settings(spark, path)
    assert sorted((r["name"], r["saved_ms"], r["state"]["preset"], r["state"]["sourceSoftness"]) for r in read.collect()) == [("a", 1, "hue", 2.5), ("b", 2, "color", 2.5)]
    broken = spark.createDataFrame([row("c", 3, "hue"), row("d", 4, "hue")], schema).repartition(2).withColumn("name", F.when(F.col("name") == "d", F.raise_error(F.lit("stop"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="stop"):
        S.save_settings(broken, path)
    assert sorted(r["name"] for r in S.load_settings(spark, path).collect()) == ["a", "b"]
    assert len(list(tmp_path.glob("s/v-*"))) == 1
    for k in range(3):
        S.save_settings(spark.createDataFrame([row("a", k, "hue")], schema), path)
    assert [r["saved_ms"] for r in S.load_settings(spark, path).collect()] == [2] and len(list(tmp_path.glob("s/v-*"))) == S.KEEP
    S.save_settings(spark.createDataFrame([], schema), path)
    assert S.load_settings(spark, path).count() == 0
    assert S.load_settings(spark, f"{tmp_path}/none").count() == 0
