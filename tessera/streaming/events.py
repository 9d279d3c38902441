"""Operators over event streams: each takes and gives DataFrames and works on batches; debounce, throttle and the latest value also run as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, gap: str, owner: str = "user_id", ts: str = "ts") -> DataFrame:
    """owner, first, last, n: one row per burst, which ends when no event comes for the gap. Streams need a watermark."""
    return events.groupBy(owner, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).select(owner, "first", "last", "n")


def changes(events: DataFrame, value: str, owner: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events whose value is not that of their owner's last event."""
    before = F.lag(value).over(W.partitionBy(owner).orderBy(*order))
    return events.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def latest(events: DataFrame, value: str, token: str, owner: str = "user_id") -> DataFrame:
    """owner and the value of the greatest token; partial sums keep one row per owner and task."""
    return events.groupBy(owner).agg(F.max_by(value, token).alias(value), F.max(token).alias(token))


def without_echo(events: DataFrame, own: str, within: str, owner: str = "user_id") -> DataFrame:
    """Events that are no own write and do not come within the time after their owner's last own write."""
    is_own = F.expr(own)
    last = F.max(F.when(is_own, F.col("ts"))).over(W.partitionBy(owner).orderBy("ts").rangeBetween(W.unboundedPreceding, 0))
    df = events.withColumn("_own", last)
    return df.filter(~is_own & (F.col("_own").isNull() | (F.col("ts") >= F.col("_own") + F.expr(f"INTERVAL {within}")))).drop("_own")


def flush_pauses(events: DataFrame, owner: str = "user_id") -> DataFrame:
    """events(owner, id, ms, act) -> owner, id, at_ms of all acts but pause and resume: an event between a pause and its owner's next resume waits for that resume (null while none has come), all others pass at once."""
    order = W.partitionBy(owner).orderBy("ms", "id")
    turn = F.last(F.when(F.col("act").isin("pause", "resume"), F.col("act")), True).over(order)
    resumed = F.first(F.when(F.col("act") == "resume", F.col("ms")), True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    df = events.select(owner, "id", "act", F.when(turn == "pause", resumed).otherwise(F.col("ms")).alias("at_ms"))
    return df.filter(~F.col("act").isin("pause", "resume")).drop("act")


def throttle_stream(events: DataFrame, wait_ms: int, owner: str = "user_id") -> DataFrame:
    """As the batch throttle, for a stream of (owner, ms, value) in event time: windows are kept as state and fire once an event passes their end.

    With a column ts and a watermark on it, a window also fires when the watermark passes its end, and its state goes; without one,
    an owner's last window waits for the owner's next event. Within a micro-batch, events are taken in order of ms."""
    schema = f"{owner} long, open_ms long, fire_ms long, n int, last double"
    timed = "ts" in events.columns
    names = [owner, "open_ms", "fire_ms", "n", "last"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ms, n, last = state.get if state.exists else (None, 0, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], open_ms, open_ms + wait_ms, n, last)], columns=names)
            return
        for ms, value in pd.concat(list(frames)).sort_values("ms", kind="stable")[["ms", "value"]].itertuples(index=False):
            if open_ms is not None and ms - open_ms >= wait_ms:
                out.append((key[0], open_ms, open_ms + wait_ms, n, last))
                open_ms, n = None, 0
            open_ms, n, last = ms if open_ms is None else open_ms, n + 1, float(value)
        state.update((int(open_ms), int(n), last))
        if timed:
            state.setTimeoutTimestamp(max(int(open_ms) + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return events.groupBy(owner).applyInPandasWithState(run, schema, "open_ms long, n int, last double", "append", timeout)
