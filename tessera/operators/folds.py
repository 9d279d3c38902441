"""Sequential folds: state that each row changes, per key, in order.

Rows are dealt by key and sorted within partitions, and a task streams over them, holding one key's state at a time; no key's rows
are gathered. A single key is sequential by nature and stays in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], schema: str, begin: Callable, step: Callable[..., Iterable[tuple]], end: Callable[..., Iterable[tuple]]) -> DataFrame:
    """begin() makes a key's state; step(key, state, row) and end(key, state) give output tuples of the schema. row is a dict."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, some = None, None, False

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(out_schema.names, r, strict=True)) for r in rows], schema=out_schema)

        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                if not some or row[key] != now:
                    if some:
                        out += end(now, state)
                    now, state, some = row[key], begin(), True
                out += step(now, state, row)
            if out:
                yield made(out)
        if some and (out := list(end(now, state))):
            yield made(out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


CAP, SAME_WITHIN_MS, UNDO_CAP = 5, 2000, 30


@dataclass
class History:
    entries: list[dict] = field(default_factory=list)

    def push(self, e: dict, cap: int = CAP, within: int = SAME_WITHIN_MS) -> None:
        """Newest first. An entry like the newest unpinned one, and soon after it, is left out; the cap is for unpinned ones only."""
        top = next((x for x in self.entries if not x["pinned"]), None)
        if top and e["ms"] - top["ms"] < within and e["key"] == top["key"]:
            return
        every = [e, *self.entries]
        self.entries = [x for x in every if x["pinned"]] + [x for x in every if not x["pinned"]][:cap]


def push_history(entries: DataFrame, owner: str = "user_id", cap: int = CAP, within: int = SAME_WITHIN_MS) -> DataFrame:
    """entries(owner, id, ms, key, pinned) in the order of ms and id -> owner, pos, id: each owner's history after all pushes."""
    def step(k, state, row):
        state.push(row, cap, within)
        return ()

    return fold(entries, owner, ["ms", "id"], f"{owner} long, pos int, id long", History, step, lambda k, s: [(k, i, e["id"]) for i, e in enumerate(s.entries)])


@dataclass
class Undo:
    present: str | None = None
    past: list = field(default_factory=list)
    future: list = field(default_factory=list)

    def change(self, new: str) -> None:
        if new == self.present:
            return
        if self.present is not None:
            self.past = [*self.past, self.present][-UNDO_CAP:]
        self.present, self.future = new, []

    def undo(self) -> None:
        if self.past:
            self.future = [*self.future, self.present][-UNDO_CAP:]
            self.present = self.past.pop()

    def redo(self) -> None:
        if self.future:
            self.past = [*self.past, self.present][-UNDO_CAP:]
            self.present = self.future.pop()


def undo_fold(actions: DataFrame, owner: str = "user_id") -> DataFrame:
    """actions(owner, id, ms, act, state): act is change, undo or redo -> owner, present, undo_depth, redo_depth."""
    def step(k, state, row):
        if row["act"] == "change":
            state.change(row["state"])
        else:
            getattr(state, row["act"])()
        return ()

    return fold(actions, owner, ["ms", "id"], f"{owner} long, present string, undo_depth int, redo_depth int", Undo, step, lambda k, s: [(k, s.present, len(s.past), len(s.future))])
