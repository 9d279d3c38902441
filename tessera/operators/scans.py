"""Folds of one key's rows by many tasks: chunks in order, each begun with a guess of its state, until all guesses hold.

Rows are cut into ranges of owner and order, so an owner of very many rows has a chunk in every task. Each chunk is folded from the
starting state at first. Then a chunk whose predecessor ended in another state than the one it began with is folded again from that
state, and so on until every chunk began where the one before it ended, which is the fold's own result. A round settles at least
one more chunk of every owner; where a chunk's end no longer depends on its beginning, as after more changes than a stack holds,
all behind it are settled at once. Owners with open chunks after ROUNDS rounds go through these once more in order, one task an
owner: only that is left for actions whose result does depend on all before, such as one value set over and over.

States are JSON texts and must be of bounded size; a step's effect may depend on nothing but state and row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.operators.folds import Undo
from tessera.sources.shared import discard, materialize

ROUNDS = 8


def _folded(rows: DataFrame, heads: DataFrame, keys: list[str], load: Callable[[str], Any], step: Callable[[Any, dict], None], dump: Callable[[Any], str]) -> DataFrame:
    """rows(owner, part, o0.., row) and heads(owner, part, before) -> owner, part, before, after. A part without a head goes on with its owner's state."""
    kinds = dict(rows.dtypes)
    made = to_arrow_schema(_parse_datatype_string(f"owner {kinds['owner']}, part int, before string, after string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, state = None, None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["owner"], r["part"]) != now:
                    if now is not None:
                        out.append((*now, before, dump(state)))
                    before = r["before"] if r["head"] else dump(state)
                    now, state = (r["owner"], r["part"]), load(before)
                if not r["head"]:
                    step(state, r["row"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, before, dump(state)), made, strict=True)], schema=made)

    both = rows.withColumn("head", F.lit(False)).unionByName(heads.select("owner", "part", "before").withColumn("head", F.lit(True)), allowMissingColumns=True)
    order = [c for c in rows.columns if c not in ("owner", "part", "row")]
    dealt = both.repartition(*keys).sortWithinPartitions("owner", "part", F.desc("head"), *order)
    return dealt.select("owner", "part", "head", "before", "row").mapInArrow(run, f"owner {kinds['owner']}, part int, before string, after string")


def _of(rows: DataFrame, some: DataFrame, how: str, part: str = "=") -> DataFrame:
    """The rows that have (left_semi) or lack (left_anti) a partner by owner and part."""
    other = some.select(F.col("owner").alias("_owner"), F.col("part").alias("_part"))
    met = F.col("part") == F.col("_part") if part == "=" else F.col("part") >= F.col("_part")
    return rows.join(other, F.col("owner").eqNullSafe(F.col("_owner")) & met, how)


def chunk_states(df: DataFrame, owner: str, order: list[str], start: str, load: Callable[[str], Any], step: Callable[[Any, dict], None], dump: Callable[[Any], str]) -> DataFrame:
    """owner, part, before, after: the state before and after each chunk of an owner's rows. start is the state before all; step changes a loaded state by a row's other columns."""
    names = [f"o{i}" for i in range(len(order))]
    rest = F.struct(*[df[f"`{c}`"] for c in df.columns if c not in (owner, *order)]).alias("row")
    rows = df.select(F.col(owner).alias("owner"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], rest)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(tasks, "owner", *names).withColumn("part", F.spark_partition_id()), "chunks")
    heads = rows.select("owner", "part").distinct().withColumn("before", F.lit(start))
    states = materialize(_folded(rows, heads, ["owner", "part"], load, step, dump), "states")
    behind = Window.partitionBy("owner").orderBy("part")
    for i in range(ROUNDS + 1):
        then = F.coalesce(F.lag("after").over(behind), F.lit(start))
        open_ = materialize(states.withColumn("then", then).filter("then <> before").select("owner", "part", F.col("then").alias("before")), "heads")
        if open_.isEmpty():
            discard(open_)
            break
        if i < ROUNDS:
            changed = _folded(_of(rows, open_, "left_semi"), open_, ["owner", "part"], load, step, dump)
        else:
            heads = open_.groupBy("owner").agg(F.min_by("before", "part").alias("before"), F.min("part").alias("part"))
            changed = _folded(_of(rows, heads, "left_semi", ">="), heads, ["owner"], load, step, dump)
        changed = materialize(changed, "changed")
        newer = materialize(_of(states, changed, "left_anti").unionByName(changed), "states")
        discard(states, changed, open_)
        states = newer
    discard(rows)
    return states


def _load(s: str) -> Undo:
    return Undo(**json.loads(s))


def _dump(u: Undo) -> str:
    return json.dumps({"present": u.present, "past": u.past, "future": u.future}, ensure_ascii=False)


def _act(u: Undo, row: dict) -> None:
    u.change(row["state"]) if row["act"] == "change" else getattr(u, row["act"])()


def undo_scan(actions: DataFrame, owner: str = "user_id") -> DataFrame:
    """actions(owner, id, ms, act, state): act is change, undo or redo -> owner, present, undo_depth, redo_depth, as undo_fold gives; an
    owner's rows are dealt over all tasks. Rows of one ms and id must be alike; an empty table gives an empty result; extra columns are ignored."""
    rows = actions.select(F.col(owner).alias("owner"), "ms", "id", "act", F.col("state").cast("string").alias("state"))
    states = chunk_states(rows, "owner", ["ms", "id"], _dump(Undo()), _load, _act, _dump)
    last = states.groupBy("owner").agg(F.max_by("after", "part").alias("s"))
    last = last.withColumn("s", F.from_json("s", "present string, past array<string>, future array<string>"))
    return last.select(F.col("owner").alias(owner), "s.present", F.size("s.past").alias("undo_depth"), F.size("s.future").alias("redo_depth"))
