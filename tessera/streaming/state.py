"""Live versions of the sequential operators: a state machine an owner, kept in the state store and moved on by every micro-batch.

A query stopped and started again on its checkpoint goes on where it was. Within a micro-batch an owner's events are taken in order
of ms and id, so micro-batches that follow one another in time give what the batch operators give. States are of bounded size
(a value, an undo stack, a history and its pinned entries), but for the events that wait while their owner is paused, which are a list of the
store's own, appended to and read through. The echo's state goes when the watermark passes its end.

The state store must be one that keeps several states a key (ROCKS_DB); streams() sets it for a session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.folds import CAP, SAME_WITHIN_MS, History, Undo

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streams(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


def ordered(rows: Iterator[Row]) -> list[dict]:
    """Rows by ms and id, nulls last."""
    place = lambda x: (x is None, 0 if x is None else x)
    return sorted((r.asDict() for r in rows), key=lambda r: (place(r["ms"]), place(r["id"])))


class Machine(StatefulProcessor):
    """step(owner, state, row) and end(owner, state) give output tuples; a state is what load makes of the JSON that dump made of it."""

    def __init__(self, names: list[str], begin: Callable, step: Callable, dump: Callable = lambda s: s, load: Callable = lambda x: x, end: Callable = lambda k, s: [], until: Callable[[Any], int | None] = lambda s: None):
        self.begin, self.step, self.dump, self.load, self.end, self.until = begin, step, dump, load, end, until
        self.row = lambda r: Row(**dict(zip(names, r, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("state", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.kept.exists()
        state = self.load(json.loads(self.kept.get()[0])) if held else self.begin()
        before = self.until(state) if held else None
        out = [r for row in ordered(rows) for r in self.step(key[0], state, row)] + list(self.end(key[0], state))
        self.kept.update((json.dumps(self.dump(state)),))
        until = self.until(state)
        if until is not None and until != before:
            self.handle.registerTimer(until)
        return map(self.row, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists():
            until = self.until(self.load(json.loads(self.kept.get()[0])))
            if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
                self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def run(events: DataFrame, owner: str, schema: str, machine: StatefulProcessor, timed: bool = False) -> DataFrame:
    return events.groupBy(owner).transformWithState(machine, schema, "Append", "EventTime" if timed else "None")


def _schema(events: DataFrame, owner: str, rest: str) -> tuple[str, list[str]]:
    return f"{owner} {dict(events.dtypes)[owner]}, {rest}", [owner, *[c.split()[0] for c in rest.split(", ")]]


def changes(events: DataFrame, owner: str = "user_id") -> DataFrame:
    """events(owner, id, ms, value string) -> owner, id, value of those whose value is not that of their owner's last event."""
    schema, names = _schema(events, owner, "id long, value string")

    def step(key, state, row):
        new = "last" not in state or row["value"] is not None and state["last"] is not None and row["value"] != state["last"] or state["last"] is None
        state["last"] = row["value"]
        return [(key, row["id"], row["value"])] if new else []

    return run(events, owner, schema, Machine(names, dict, step))


def without_echo(events: DataFrame, within_ms: int, owner: str = "user_id") -> DataFrame:
    """events(owner, id, ms, own boolean) -> owner, id, ms of those that are no own write, nor come within the time after their owner's last one.

    With a column ts and a watermark on it, an owner's state goes once the watermark has passed that time."""
    schema, names = _schema(events, owner, "id long, ms long")

    def step(key, state, row):
        if row["own"]:
            state["last"] = max(row["ms"], state.get("last", row["ms"]))
            return []
        return [] if "last" in state and row["ms"] < state["last"] + within_ms else [(key, row["id"], row["ms"])]

    timed = "ts" in events.columns
    until = (lambda s: s["last"] + within_ms if "last" in s else None) if timed else (lambda s: None)
    return run(events, owner, schema, Machine(names, dict, step, until=until), timed)


def push_history(entries: DataFrame, owner: str = "user_id", cap: int = CAP, within: int = SAME_WITHIN_MS) -> DataFrame:
    """entries(owner, id, ms, key, pinned) -> owner, upto, pos, entry: an owner's whole history after each micro-batch that changed it;
    upto counts the owner's pushes so far, so the rows of the greatest one hold."""
    schema, names = _schema(entries, owner, "upto long, pos int, entry long")

    def step(key, state, row):
        state[0] += 1
        state[1].push({c: row[c] for c in ("id", "ms", "key", "pinned")}, cap, within)
        return []

    end = lambda key, state: [(key, state[0], i, e["id"]) for i, e in enumerate(state[1].entries)]
    dump, load = (lambda s: [s[0], s[1].entries]), (lambda x: [x[0], History(x[1])])
    return run(entries, owner, schema, Machine(names, lambda: [0, History()], step, dump, load, end))


def undo(actions: DataFrame, owner: str = "user_id") -> DataFrame:
    """actions(owner, id, ms, act, state) -> owner, upto, present, undo_depth, redo_depth after each micro-batch; see push_history for upto."""
    schema, names = _schema(actions, owner, "upto long, present string, undo_depth int, redo_depth int")

    def step(key, state, row):
        state[0] += 1
        if row["act"] == "change":
            state[1].change(row["state"])
        else:
            getattr(state[1], row["act"])()
        return []

    end = lambda key, state: [(key, state[0], state[1].present, len(state[1].past), len(state[1].future))]
    dump, load = (lambda s: [s[0], s[1].present, s[1].past, s[1].future]), (lambda x: [x[0], Undo(*x[1:])])
    return run(actions, owner, schema, Machine(names, lambda: [0, Undo()], step, dump, load, end))


class Pauses(StatefulProcessor):
    """What waits is a list in the store, so that no state is read to add to it. It holds something only of an owner whose last micro-batch ended paused, so it is read at most once a micro-batch."""

    def __init__(self, names: list[str]):
        self.row = lambda *r: Row(**dict(zip(names, r, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paused, self.waiting = handle.getValueState("paused", "paused boolean"), handle.getListState("waiting", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = stored = self.paused.exists() and self.paused.get()[0]
        paused, out, late = before, [], []
        for row in ordered(rows):
            if row["act"] == "pause":
                paused = True
            elif row["act"] == "resume":
                paused = False
                if stored:
                    out += [self.row(key[0], x[0], row["ms"]) for x in self.waiting.get()] if self.waiting.exists() else []
                    self.waiting.clear()
                    stored = False
                out += [self.row(key[0], i, row["ms"]) for (i,) in late]
                late = []
            elif paused:
                late.append((row["id"],))
            else:
                out.append(self.row(key[0], row["id"], row["ms"]))
        if late:
            self.waiting.appendList(late)
        if paused != before:
            self.paused.update((paused,))
        return iter(out)

    def close(self) -> None:
        pass


def flush_pauses(events: DataFrame, owner: str = "user_id") -> DataFrame:
    """events(owner, id, ms, act) -> owner, id, at_ms of what passes: at once, or at the resume that ends its owner's pause."""
    schema, names = _schema(events, owner, "id long, at_ms long")
    return run(events, owner, schema, Pauses(names))
