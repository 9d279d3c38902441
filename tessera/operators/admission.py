"""Throttles and in-flight guards: of an owner's events those that come while none taken before is at work, with no owner in one task.

An event that is taken keeps its owner busy for a time; the next one is the first event after that. Which events are taken depends
on all earlier ones, but a stretch of time only hands on one number, from when on its owner is free. So time is cut into chunks
of SPAN times the longest work, and a chunk's part is a step function: for every event that may be the first one taken, the end
of the last work that follows. Steps of equal ends are one. Functions of FAN chunks are composed to that of a longer chunk until
an owner has at most FAN; then the free times are handed down again, level by level, and every chunk takes its events by itself.

Of an owner's events of one millisecond only the first can be taken, so rows are first aggregated by owner and millisecond; a chunk has
at most as many of them as milliseconds. One owner's events thus spread over as many tasks as they have chunks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.sources.shared import materialize

SPAN, FAN = 64, 64
NEVER = -(1 << 62)
Steps = tuple[list[int], list[int]]  # for free times up to an entry, the end of the last work


def chunks_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of equal first columns, of batches that are sorted by them."""
    now, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        listed = list(zip(*[b.column(k).to_pylist() for k in range(keys)], strict=True))
        cuts = [0, *[i for i in range(1, len(listed)) if listed[i] != listed[i - 1]], len(listed)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if parts and listed[lo] != now:
                yield now, pa.concat_batches(parts)
                parts = []
            now = listed[lo]
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield now, pa.concat_batches(parts)


def _streamed(df: DataFrame, keys: list[str], order: str, schema: str, one: Callable[[tuple, pa.RecordBatch], list[tuple]]) -> DataFrame:
    """one(key, rows) for the rows of every key, in order; a task holds the rows of one key."""
    made = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in chunks_of(batches, len(keys)):
            found = one(key, rows)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), made, strict=True)], schema=made)

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def column(rows: pa.RecordBatch, name: str) -> list:
    return rows.column(rows.schema.get_field_index(name)).to_pylist()


def apply(steps: Steps, free: int) -> int:
    """When the owner is free after a chunk, if it is free from the given time on before."""
    k = bisect_left(steps[0], free)
    return steps[1][k] if k < len(steps[0]) else free


def joined(entries: list[int], ends: list[int]) -> Steps:
    """Neighbouring steps of one end made one."""
    keep = [i for i in range(len(entries)) if i + 1 == len(entries) or ends[i + 1] != ends[i]]
    return [entries[i] for i in keep], [ends[i] for i in keep]


def steps_of(ms: np.ndarray, busy: np.ndarray, until: int) -> Steps:
    """The steps of a chunk's events, sorted by ms, for free times of up to until."""
    after = np.searchsorted(ms, ms + busy, "left")
    ends = (ms + busy).tolist()
    for i in range(len(ends) - 1, -1, -1):
        if after[i] < len(ends):
            ends[i] = ends[after[i]]
    n = min(len(ends), int(np.searchsorted(ms, until, "left")) + 1)
    return joined(ms[:n].tolist(), ends[:n])


def composed(parts: list[Steps]) -> Steps:
    """The steps of consecutive chunks: those of the first, and one for all that come free after its last event."""
    entries = [*parts[0][0], *(parts[1][0][:1] if len(parts) > 1 else [])]
    ends = []
    for e in entries:
        free = e
        for p in parts:
            free = apply(p, free)
        ends.append(free)
    return joined(entries, ends)


STEPS = "entries array<long>, ends array<long>"


def _free_times(owned: str, rows: DataFrame, span: int, longest: int) -> DataFrame:
    """rows(owner, chunk, ms, busy), one an owner and millisecond -> owner, chunk, free: from when on the owner is free, as told by all earlier chunks."""
    head = f"owner {owned}, chunk long"

    def summary(key: tuple, part: pa.RecordBatch) -> list[tuple]:
        ms, busy = (np.array(column(part, c), np.int64) for c in ("ms", "busy"))
        return [(*key, *steps_of(ms, busy, key[1] * span + longest))]

    def compose(key: tuple, part: pa.RecordBatch) -> list[tuple]:
        return [(*key, *composed(list(zip(column(part, "entries"), column(part, "ends"), strict=True))))]

    def hand_on(key: tuple, part: pa.RecordBatch) -> list[tuple]:
        free, out = column(part, "free")[0], []
        for chunk, *steps in zip(*[column(part, c) for c in ("chunk", "entries", "ends")], strict=True):
            out.append((key[0], chunk, free))
            free = apply(steps, free)
        return out

    levels = [materialize(_streamed(rows.select("owner", "chunk", "ms", "busy"), ["owner", "chunk"], "ms", f"{head}, {STEPS}", summary), "steps")]
    while (levels[-1].groupBy("owner").count().agg(F.max("count")).first()[0] or 0) > FAN:
        longer = levels[-1].withColumn("small", F.col("chunk")).withColumn("chunk", F.floor(F.col("chunk") / FAN))
        levels.append(materialize(_streamed(longer, ["owner", "chunk"], "small", f"{head}, {STEPS}", compose), "steps"))
    free = _streamed(levels.pop().withColumn("free", F.lit(NEVER)), ["owner"], "chunk", f"{head}, free long", hand_on)
    while levels:
        above = free.select(F.col("owner").alias("_owner"), F.col("chunk").alias("long"), "free")
        below = levels.pop().withColumn("large", F.floor(F.col("chunk") / FAN))
        below = below.join(above, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("large") == F.col("long"))).drop("_owner", "long")
        free = _streamed(below, ["owner", "large"], "chunk", f"{head}, free long", hand_on)
    return free


def _with_free(rows: DataFrame, longest: int) -> DataFrame:
    """rows(owner, ms, busy, ...) with chunk and the owner's free time before it."""
    span = SPAN * longest
    rows = rows.withColumn("chunk", F.floor(F.col("ms") / F.lit(span)))
    free = _free_times(dict(rows.dtypes)["owner"], rows, span, longest)
    free = free.select(F.col("owner").alias("_owner"), F.col("chunk").alias("_chunk"), "free")
    return rows.join(free, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("chunk") == F.col("_chunk"))).drop("_owner", "_chunk")


def guard(events: DataFrame, busy_ms: str = "busy_ms", owner: str = "user_id", order: str = "id") -> DataFrame:
    """events(owner, id, ms, busy_ms) -> all columns of those that start work: they come while no work of their owner is going on, which
    takes busy_ms, at least one. Others are dropped. Of one millisecond the least id comes first. Events without ms or busy_ms are dropped."""
    whole = F.struct(*[events[f"`{c}`"] for c in events.columns])
    rows = events.select(F.col(owner).alias("owner"), F.col("ms").cast("long").alias("ms"), F.when(F.col(busy_ms).isNotNull(), F.greatest(F.col(busy_ms).cast("long"), F.lit(1))).alias("busy"), F.col(order).alias("order"), whole.alias("row"))
    rows = rows.filter("ms IS NOT NULL AND busy IS NOT NULL")
    firsts = rows.groupBy("owner", "ms").agg(F.min_by(F.struct("busy", "row"), "order").alias("f")).select("owner", "ms", "f.busy", "f.row")
    longest = firsts.agg(F.max("busy")).first()[0] or 1
    timed = _with_free(firsts, longest)
    kind = timed.schema["row"].dataType.simpleString()

    def taken(key: tuple, part: pa.RecordBatch) -> list[tuple]:
        free, out, rows_at = column(part, "free")[0], [], part.schema.get_field_index("row")
        for i, (ms, busy) in enumerate(zip(column(part, "ms"), column(part, "busy"), strict=True)):
            if ms >= free:
                out.append((part.column(rows_at)[i].as_py(),))
                free = ms + busy
        return out

    found = _streamed(timed, ["owner", "chunk"], "ms", f"row {kind}", taken)
    return found.select(*[F.col("row").getField(c).alias(c) for c in events.columns])


def throttle(events: DataFrame, wait_ms: int, owner: str = "user_id") -> DataFrame:
    """events(owner, id, ms, value) -> owner, open_ms, fire_ms, n, last: a window opens at the first event after the last window, and its
    last value (by ms and id) fires at its end. Events without ms are dropped."""
    rows = events.filter("ms IS NOT NULL").groupBy(F.col(owner).alias("owner"), F.col("ms").cast("long").alias("ms"))
    rows = rows.agg(F.count("*").alias("n"), F.max_by("value", "id").alias("last")).withColumn("busy", F.lit(wait_ms).cast("long"))
    timed = _with_free(rows, wait_ms)
    kinds = dict(timed.dtypes)

    def windows(key: tuple, part: pa.RecordBatch) -> list[tuple]:
        free, out = column(part, "free")[0], []
        for ms, n, last in zip(*[column(part, c) for c in ("ms", "n", "last")], strict=True):
            if ms >= free:
                free = ms + wait_ms
            if out and out[-1][1] == free - wait_ms:
                out[-1] = (key[0], free - wait_ms, out[-1][2] + n, ms, last)
            else:
                out.append((key[0], free - wait_ms, n, ms, last))
        return out

    # a window that crosses a chunk's end has a row in both
    parts = _streamed(timed, ["owner", "chunk"], "ms", f"owner {kinds['owner']}, open_ms long, n long, ms long, last {kinds['last']}", windows)
    whole = parts.groupBy("owner", "open_ms").agg(F.sum("n").cast("int").alias("n"), F.max_by("last", "ms").alias("last"))
    return whole.select(F.col("owner").alias(owner), "open_ms", (F.col("open_ms") + wait_ms).alias("fire_ms"), "n", "last")
