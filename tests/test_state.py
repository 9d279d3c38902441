from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import folds as H
from tessera.plans import live
from tessera.streaming import events as E
from tessera.streaming import state as S

ACTS = ["event", "event", "event", "pause", "event", "event", "resume"]


def rows(n=160):
    """Three users; ms rises, now and then two events share one."""
    return [(i * 7 % 3, i, 1000 + i // 2 * 37, ACTS[i * 5 % 11 % 7], "abc"[i // 3 % 3], i % 9 == 0, i % 13 == 0) for i in range(n)]


SCHEMA = "user_id long, id long, ms long, act string, value string, own boolean, pinned boolean"


def streamed(spark, folder, made, parts=4):
    """The stream's output: two files to a query, which is then stopped and started anew on its checkpoint, and the rest."""
    S.streams(spark)
    out = []
    all_rows = rows()
    step = len(all_rows) // parts // 2 * 2
    for k in range(parts):
        part = all_rows[k * step : (k + 1) * step if k < parts - 1 else None]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k % 2:
            stream = made(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
            q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(180)
    out = spark.read.parquet(f"{folder}/out")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out


def batch(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_echo(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda df: S.without_echo(df.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", "1 second"), 150))
    want = E.without_echo(batch(spark).withColumn("ts", F.timestamp_millis("ms")), "own", "150 milliseconds").select("user_id", "id", "ms")
    same(got, want)


def test_changes(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda df: S.changes(df))
    same(got, E.changes(batch(spark), "value", order=("ms", "id")).select("user_id", "id", "value"))


def test_pauses(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda df: S.flush_pauses(df))
    same(got, E.flush_pauses(batch(spark)).filter("at_ms IS NOT NULL"))


@pytest.mark.parametrize("kind", ["history", "undo"])
def test_histories(spark, tmp_path, kind):
    if kind == "history":
        got = streamed(spark, tmp_path, lambda df: S.push_history(df.withColumnRenamed("value", "key"), cap=3, within=60))
        want = H.push_history(batch(spark).withColumnRenamed("value", "key"), cap=3, within=60)
    else:
        act = F.when(F.col("act") == "pause", "undo").when(F.col("act") == "resume", "redo").otherwise("change").alias("act")
        shaped = lambda df: df.select("user_id", "id", "ms", act, F.col("value").alias("state"))
        got = streamed(spark, tmp_path, lambda df: S.undo(shaped(df)))
        want = H.undo_fold(shaped(batch(spark)))
    last = got.groupBy("user_id").agg(F.max("upto").alias("upto"))
    same(got.join(last, ["user_id", "upto"]).drop("upto"), want)


class Kept:
    """A state that counts its reads."""

    def __init__(self, value=()):
        self.value, self.reads = list(value), 0

    def exists(self):
        return bool(self.value)

    def get(self):
        self.reads += 1
        return self.value[0] if isinstance(self.value[0], tuple) and isinstance(self.value[0][0], bool) else iter(self.value)

    def clear(self):
        self.value = []

    def update(self, value):
        self.value = [value]

    def appendList(self, values):
        self.value += values


def test_what_waits_is_read_once_a_micro_batch():
    """However many resumes it has; and an owner that is not paused costs no read of the list. Rows come as rows, no frame an owner."""
    p = S.Pauses(["user_id", "id", "at_ms"])
    acts = ["event", "resume", "event", "resume", "pause", "event", "event", "resume", "resume", "pause", "event"]
    batch = lambda at: (Row(user_id=7, id=at + i, ms=at + i, act=a) for i, a in reversed(list(enumerate(acts))))
    p.paused, p.waiting = Kept([(True,)]), Kept([(1,), (2,)])
    got = [tuple(r) for r in p.handleInputRows((7,), batch(100), None)]
    assert got == [(7, 1, 101), (7, 2, 101), (7, 100, 101), (7, 102, 102), (7, 105, 107), (7, 106, 107)] and p.waiting.reads == 1
    assert p.paused.value == [(True,)] and p.waiting.value == [(110,)]
    p.paused, p.waiting = Kept([(False,)]), Kept()
    list(p.handleInputRows((7,), batch(100), None))
    assert p.waiting.reads == 0 and p.paused.value == [(True,)]


def test_a_part_of_a_stream_is_written_by_all_tasks(spark):
    """One task wrote each part, and one read it."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("tessera/history-*"))
    assert live.history_stream(spark, "/root/testdata/sf0.001").count()
    (made,) = set(root.glob("tessera/history-*")) - before
    users = [{r["user_id"] for r in spark.read.parquet(str(p)).select("user_id").distinct().collect()} for p in made.glob("in/*.parquet")]
    assert len(users) > live.PARTS and all(sum(u in x for x in users) <= live.PARTS for u in set().union(*users))
