import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import folds as H
from tessera.operators import scans as S

SCHEMA = "user_id long, id long, ms long, act string, state string"


def actions(seed, n, users, acts, values):
    rng = random.Random(seed)
    return [(rng.choice(users), i, rng.randint(0, n // 3), rng.choice(acts), rng.choice(values)) for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("n", "users", "acts", "values"),
    [
        (3000, [7], ["change"] * 3 + ["undo", "redo"], ["a", "b", "c\"\n", "é"]),
        (1200, [1, 1, 1, 2, None], ["change", "undo", "undo", "redo"], ["a", "b"]),
        (600, [1], ["change"], ["a"]),
    ],
)
def test_equals_the_fold(spark, n, users, acts, values):
    df = spark.createDataFrame(actions(n, n, users, acts, values), SCHEMA).repartition(3)
    assert rows_of(S.undo_scan(df)) == rows_of(H.undo_fold(df))


def test_a_state_that_goes_through_all_chunks(spark, monkeypatch):
    """Ten changes, then undos and redos only: every chunk depends on the first one, and the last pass in order is needed."""
    monkeypatch.setattr(S, "ROUNDS", 2)
    rows = [(1, i, i, "change", f"v{i}") for i in range(10)] + [(1, i, i, "undo" if i % 2 else "redo", None) for i in range(10, 800)]
    df = spark.createDataFrame([*rows, (2, 1, 1, "change", "x")], SCHEMA)
    assert rows_of(S.undo_scan(df)) == rows_of(H.undo_fold(df))


def test_one_owner_spreads_over_all_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).alias("user_id"), "id", F.col("id").alias("ms"), F.lit("change").alias("act"), F.concat(F.lit("s"), F.col("id")).alias("state"))
    df = df.withColumn("part", F.lit("clash")).withColumn("before", F.lit(1))
    states = S.chunk_states(df, "user_id", ["ms", "id"], S._dump(H.Undo()), S._load, S._act, S._dump)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert states.count() == tasks > 1
    assert rows_of(S.undo_scan(df)) == [(1, "s39999", 30, 0)]


def test_empty_table(spark):
    assert S.undo_scan(spark.createDataFrame([], SCHEMA)).collect() == []
