"""Periodic runs of words: where a text repeats itself back to back, found by the divide and conquer of Main and Lorentz.

A run is a stretch of consecutive words with smallest period q, of a length of at least max(LEAST, 2 q), that no neighbouring
word extends keeping that period. Words are interned to ids. A segment is cut at its middle; the Z-function of its right half
before the segment, and that of its reversed left half before the reversed segment, tell for every period how far the words
around the cut agree, hence all repetitions that cross it. They are extended to where they end; one that goes on beyond the
segment was found whole where it was cut before. Equal intervals are one run, of the smallest period, and both halves follow.

A run holds two equal stretches of GRAM words, one period apart. So a segment is first narrowed to the hull of the equal
neighbouring stretches that lie inside it, and left where there are none: nothing is lost, and most texts cost one sort.

Defined results: a null or empty text has no words and no runs; white space is that of ASCII, and all other characters are part
of words; equal rows give equal rows; an empty table gives an empty result; extra columns are carried along whatever their
names. A text is handled whole, in O(n log n) steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, GRAM = 12, 6
Run = tuple[int, int, int]


def z_function(s: list[int]) -> list[int]:
    """How many items from each place on equal those from the start on; s holds no -2."""
    n = len(s)
    s = [*s, -2]
    z, left, right, first = [0] * n, 0, 0, s[0]
    z[0] = n
    for i in range(1, n):
        if i >= right:
            if s[i] != first:
                continue
            k = 1
        else:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def crossing(w: list[int], lo: int, mid: int, hi: int) -> Iterator[Run]:
    """start, end and a period of every stretch of w[lo:hi] that meets the cut at mid, goes on neither way within w, and is long enough."""
    whole, nu, nv = w[lo:hi], mid - lo, hi - mid
    ahead = z_function([*w[mid:hi], -1, *whole])
    back = z_function([*w[lo:mid][::-1], -1, *whole[::-1]])
    ahead.append(0)
    back.append(0)
    n = len(w)
    for q in range(1, nu + 1):  # a period of words before the cut, against those behind it
        before, behind = back[nu + 1 + nv + q], ahead[nv + 1 + nu - q]
        if before + behind >= q and q + before + behind >= LEAST:
            s, e = mid - q - before, mid + behind
            if not (s == lo and s and w[s - 1] == w[s - 1 + q] or e == hi and e < n and w[e] == w[e - q]):
                yield s, e, q
    for q in range(1, nv + 1):  # a period of words behind the cut, against those before it
        before, behind = back[nu + 1 + nv - q], ahead[q] if q < nv else 0
        if before + behind >= q and q + before + behind >= LEAST:
            s, e = mid - before, mid + q + behind
            if not (s == lo and s and w[s - 1] == w[s - 1 + q] or e == hi and e < n and w[e] == w[e - q]):
                yield s, e, q


def neighbours(w: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal stretches of GRAM words, each with the next of its kind. Stretches are compared by a hash: a chance equality only costs time."""
    ids = np.array(w, np.uint64)
    mixed = np.zeros(max(0, len(w) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(mixed)] + np.uint64(1)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    return order[:-1][same], order[1:][same]


def runs_of(w: list[int]) -> list[Run]:
    """start, length and smallest period of all runs of a list of ids, in the order of start and period."""
    if len(w) < LEAST:
        return []
    first, second = neighbours(w)
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(w), first, second)]
    while todo:
        lo, hi, a, b = todo.pop()
        inside = (a >= lo) & (b <= hi - GRAM)
        a, b = a[inside], b[inside]
        if not len(a):
            continue
        lo, hi = int(a.min()), int(b.max()) + GRAM
        if hi - lo < LEAST:
            continue
        mid = (lo + hi) // 2
        for s, e, q in crossing(w, lo, mid, hi):
            found[s, e] = min(q, found.get((s, e), q))
        todo += [(lo, mid, a, b), (mid, hi, a, b)]
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> bytearray:
    """1 for the words that stay: of each run only the first period is needed."""
    keep = bytearray(b"\1") * n
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return keep


def periodic_runs(docs: DataFrame, text: str = "text", rewrite: Callable[[list[bytes], dict], list[bytes]] | None = None) -> DataFrame:
    """docs with n_words long, runs array<struct<start, length, period>> in order, and collapsed string: the text without what repeats, by single spaces.

    rewrite(words, row) may change a row's words before; row holds the other columns."""
    names = [c for c in docs.columns if c != text]
    kind = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    made = pa.schema(
        [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())]
    )

    def one(content: bytes | None, row: dict | None) -> tuple:
        words = (content or b"").split()
        if rewrite is not None:
            words = rewrite(words, row)
        ids: dict[bytes, int] = {}
        w = [ids.setdefault(x, len(ids)) for x in words]
        runs = runs_of(w) if len(w) - len(ids) >= LEAST // 2 else []  # half of a run's words, at least, were met before
        if runs:
            words = [x for x, k in zip(words, kept_words(len(w), runs), strict=True) if k]
        return len(w), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0)
            rows = whole.to_pylist() if rewrite is not None else [None] * b.num_rows
            out = [one(x, r) for x, r in zip(b.column(1).to_pylist(), rows, strict=True)]
            columns = [pa.array(list(v), f.type) for v, f in zip(zip(*out, strict=True), made, strict=True)] if out else [pa.array([], f.type) for f in made]
            yield pa.RecordBatch.from_arrays([whole, *columns], names=["row", *made.names])

    row = F.struct(*[docs[f"`{c}`"] for c in names]).alias("row")
    shape = docs.select(row).schema[0].dataType.simpleString()
    done = docs.select(row, docs[f"`{text}`"].cast("binary").alias("content")).mapInArrow(run, f"row {shape}, {kind}")
    return done.select(*[F.col("row").getField(c).alias(c) for c in names], "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def stutter(words: list[bytes], row: dict) -> list[bytes]:
    """The words that the contract's query looks at: of one document in ten, by its hash, the end becomes a repetition of some of its words."""
    h, n = row["h"], len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), "text")
    found = periodic_runs(docs, rewrite=stutter)
    long = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    return found.select("*", long.alias("long")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("long.s")).alias("start"),
        F.col("long.n").alias("length"),
        (-F.col("long.p")).alias("period"),
        F.floor(F.expr("1000 * long.n div -long.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
