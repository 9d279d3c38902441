import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import admission as D

SCHEMA = "user_id long, id long, ms long, busy_ms long, value double"


def rows_of(seed, n, users, spread):
    rng = random.Random(seed)
    return [(rng.choice(users), i, rng.randint(-spread, spread), rng.choice([None, 0, 1, 5, 30, 30, 31]), rng.random()) for i in range(n)]


def taken(rows):
    out, free = [], {}
    for u, i, ms, busy, _ in sorted((r for r in rows if r[2] is not None and r[3] is not None), key=lambda r: (r[2], r[1])):
        if ms >= free.get(u, ms):
            out.append((u, i))
            free[u] = ms + max(1, busy)
    return sorted(out, key=repr)


def windows(rows, wait):
    out, now = [], {}
    for u, _, ms, _, value in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        w = now.get(u)
        if w is None or ms - w[1] >= wait:
            w = now[u] = [u, ms, ms + wait, 0, None]
            out.append(w)
        w[3:] = [w[3] + 1, value]
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("n", "users", "spread"), [(0, [1], 5), (1, [None], 5), (400, [1, 2, None], 60), (1500, [1, 1, 1, 2], 40_000), (3000, [7], 900_000)])
def test_guard_and_throttle_equal_plain_loops(spark, monkeypatch, n, users, spread):
    monkeypatch.setattr(D, "SPAN", 2)
    monkeypatch.setattr(D, "FAN", 3)
    rows = [*rows_of(n, n, users, spread), *([(1, 10**6, None, 3, 1.0)] if n > 1 else [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(((r["user_id"], r["id"]) for r in D.guard(df).collect()), key=repr) == taken(rows)
    assert sorted(map(tuple, D.throttle(df, 30).collect()), key=repr) == windows(rows, 30)


def test_one_owner_spreads_over_all_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("user_id"), "id", (F.col("id") * 7).alias("ms"), F.lit(20).alias("busy_ms"), F.rand(1).alias("value"))
    timed = D._with_free(df.select(F.col("user_id").alias("owner"), "ms", F.col("busy_ms").cast("long").alias("busy")), 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["n"] for r in timed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert timed.count() == 200_000 and max(sizes) < 0.6 * 200_000
    got = D.guard(df)
    assert got.count() == (200_000 + 2) // 3 and got.filter("id % 3 <> 0").isEmpty()


def test_extra_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, 1, 5, 10, 0.0, "a")] * 2 + [(1, 2, 9, 10, 0.0, "b"), (1, 3, 15, 10, 0.0, "c")], f"{SCHEMA}, chunk string").withColumn("free", F.lit(1))
    assert [(r["id"], r["chunk"], r["free"]) for r in D.guard(df).orderBy("id").collect()] == [(1, "a", 1), (3, "c", 1)]
