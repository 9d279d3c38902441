"""Document fingerprints of improbable features.

A feature is a window of a text's UTF-8 bytes, of one of the lengths in SCALES. Its entropy is put in one of 1024 steps, and how
many windows of all documents fall into each step is counted, for each length; a step's rank is its place by rarity, rarest first.
In each run of R consecutive windows of the text the leftmost one of lowest rank gets a vote; windows of at least R / 4 votes are
features of level R, for each R of LEVELS; all windows are those of level 1. A text of n windows takes the largest level up to
n / SPARSE (at least 1), or the next lower one at which it has features, and all levels above. Each distinct feature sets HASHES
bits of a Bloom filter of 2048 bits; after PER_FILTER features the next filter of the chain begins. A text has a chain for each of
its levels that has features, of each length of SCALES it is long enough, and not too long, for.

Features of a level are among those of the levels below, and those of a passage are among those of any text around it, because a
run has the same vote wherever it stands. So two texts are compared on the larger of their least levels, where a passage finds all its
features again, and likeness does not jump with length.

Two chains of one length and level are compared filter by filter: the shared bits over what chance gives, normalised by the most
that could be shared; each filter of the shorter chain takes its best partner. The likeness, from 0 to 1, is the mean over the
lengths that both texts have features of, weighted by the bits of the smaller chain times the length; without any it is 0, as
for a passage too short to hold a feature of the other's level.

Defined results: a null text is empty; an empty text has the fingerprint ""; a text shorter than the least length is taken with
zero bytes before it; equal fingerprints have likeness 1, an empty one and another 0; repeated rows stay, with equal doc_id
ordered by text; one document alone is its own next; an empty table gives an empty result; extra columns are ignored. Texts are
handled whole, in blocks of about BLOCK bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, column, parallelism, table

STEPS, LEVELS, SPARSE = 1024, (1, 8, 16, 32), 32
BITS, HASHES, PER_FILTER = 2048, 5, 128
BLOCK = 400_000
MOST_RANGES = 65_536  # their bounds are literals of the plan
#: Window bytes, with the fewest and (exclusive) most bytes of a text that has a chain of them.
SCALES = {2: (1, 64), 8: (8, 1024), 32: (32, 1 << 62)}
LEAST = min(SCALES)

Print = dict[int, dict[int, np.ndarray]]  # the chains of each length by level: filters x BITS of 0 and 1


def _entropy_parts(w: int) -> np.ndarray:
    """c * log2(c) for c from 0 to w, in whole numbers of 2**-16."""
    c = np.arange(w + 1)
    return np.rint(c * np.log2(np.maximum(c, 1)) * 65536).astype(np.int64)


def entropy_steps(data: np.ndarray, w: int) -> np.ndarray:
    """The step of the window that begins at each byte but the last w - 1.

    A byte's number of equals among the w - 1 bytes before it (after it) is what it meets when it enters (leaves) a window, so
    the sum of c log2 c over all windows is a running sum of differences."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, w):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    parts = _entropy_parts(w)
    gain = np.diff(parts)
    total = np.cumsum(gain[before])
    total[w:] -= np.cumsum(gain[after])[: n - w]
    bits = np.log2(w) - total[w - 1 :] / (65536 * w)
    return np.clip(bits * ((STEPS - 1) / np.log2(w)), 0, STEPS - 1).astype(np.int64)


def _bytes(text: str) -> bytes:
    """UTF-8, brought to the least window length by zero bytes before it; nothing for an empty text."""
    b = text.encode("utf-8", "surrogatepass")
    return b.rjust(LEAST, b"\0") if b else b


def _blocks(raw: list[tuple[int, bytes]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbered texts in blocks: their numbers, their bytes joined, and where each begins (and the end)."""
    for block in blocks_of(raw, lambda x: len(x[1]), BLOCK):
        at = np.concatenate([[0], np.cumsum([len(b) for _, b in block])])
        yield [i for i, _ in block], np.frombuffer(b"".join(b for _, b in block), np.uint8), at


def count_steps(docs: DataFrame) -> dict[int, np.ndarray]:
    """How many windows of all documents fall into each step, by window length. At most STEPS rows a length come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {w: np.zeros(STEPS, np.int64) for w in SCALES}
        for b in batches:
            for _, data, at in _blocks([(0, _bytes(t)) for t in column(b, "text") if t]):
                for w in counts:
                    if len(data) >= w:
                        inside = _inside(at, w)[: len(data) - w + 1]
                        counts[w] += np.bincount(entropy_steps(data, w)[inside], minlength=STEPS)
        for w, c in counts.items():
            k = np.flatnonzero(c)
            yield pa.record_batch([pa.array(np.full(len(k), w), pa.int32()), pa.array(k, pa.int32()), pa.array(c[k], pa.int64())], names=["w", "step", "n"])

    rows = docs.select("text").mapInArrow(run, "w int, step int, n long").groupBy("w", "step").agg(F.sum("n").alias("n")).collect()
    out = {w: np.zeros(STEPS, np.int64) for w in SCALES}
    for r in rows:
        out[r["w"]][r["step"]] = r["n"]
    return out


def ranks_of(counts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Rarest step first; steps that no document has come before all, equal counts in the order of steps."""
    out = {}
    for w, c in counts.items():
        rank = np.empty(STEPS, np.int64)
        rank[np.argsort(c, kind="stable")] = np.arange(STEPS)
        out[w] = rank
    return out


def _inside(at: np.ndarray, w: int) -> np.ndarray:
    """Whether the window that begins at each byte stays in its text."""
    ok = np.ones(at[-1], bool)
    for k in range(1, w):
        ends = at[1:] - k
        ok[ends[ends >= at[:-1]]] = False
    return ok


def level_of(windows: int) -> int:
    """The largest level up to windows / SPARSE, or the least one."""
    return max(x for x in LEVELS if x <= max(LEVELS[0], windows // SPARSE))


def _levels(rank: np.ndarray, ok: np.ndarray, at: np.ndarray, w: int, least: int) -> dict[int, np.ndarray]:
    """Positions of the features of each level from least on."""
    n, span = len(rank), 1
    low = np.where(ok[:n], rank, STEPS) * (1 << 40) + np.arange(n)
    out = {}
    while span <= LEVELS[-1]:
        if span in LEVELS and span >= least:
            last = np.repeat(at[1:] - w - span + 1, np.diff(at))[: len(low)]
            votes = np.bincount((low & ((1 << 40) - 1))[np.arange(len(low)) <= last], minlength=n)
            out[span] = np.flatnonzero((4 * votes >= span) & ok[:n])
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    return out


def _hashes(data: np.ndarray, places: np.ndarray, w: int) -> np.ndarray:
    """64-bit hashes of the windows at places."""
    windows = np.lib.stride_tricks.sliding_window_view(data, w)[places]
    h = np.full(len(places), 0x9E3779B97F4A7C15 + w, np.uint64)
    words = np.zeros((len(places), -(-w // 8) * 8), np.uint8)
    words[:, :w] = windows
    for k in words.view(np.uint64).T:
        h = (h ^ k) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _filters(h: np.ndarray) -> np.ndarray:
    """The chained filters of a document's features in order, each distinct feature once: filters x BITS of 0 and 1."""
    _, first = np.unique(h, return_index=True)
    h = h[np.sort(first)]
    out = np.zeros((-(-len(h) // PER_FILTER), BITS), np.uint8)
    which = np.arange(len(h)) // PER_FILTER
    for k in range(HASHES):
        out[which, (h >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return out


def _chains(data: np.ndarray, at: np.ndarray, w: int, rank: np.ndarray) -> list[dict[int, np.ndarray]]:
    """The chains of one length, by level, of each text of a block."""
    ranks, ok = rank[entropy_steps(data, w)], _inside(at, w)[: len(data) - w + 1]
    own = [level_of(int(m)) for m in np.diff(at) - w + 1]
    out: list[dict[int, np.ndarray]] = [{} for _ in own]
    for level, places in _levels(ranks, ok, at, w, min(own)).items():
        h, ends = _hashes(data, places, w), np.searchsorted(places, at)
        for k, chains in enumerate(out):
            if level >= own[k] and ends[k] < ends[k + 1]:
                chains[level] = _filters(h[ends[k] : ends[k + 1]])
    for k, chains in enumerate(out):
        if own[k] not in chains:  # all windows tie, as in a text of one letter
            a, e = at[k], at[k + 1]
            lower = _levels(ranks[a : e - w + 1], ok[a : e - w + 1], np.array([0, e - a]), w, LEVELS[0])
            level = max(x for x, places in lower.items() if x < own[k] and len(places))
            chains[level] = _filters(_hashes(data[a:e], lower[level], w))
    return out


def fingerprints_of(texts: list[str], ranks: dict[int, np.ndarray]) -> list[Print]:
    out: list[Print] = [{} for _ in texts]
    raw = [(i, _bytes(t)) for i, t in enumerate(texts) if t]
    for w, rank in ranks.items():
        least, most = SCALES[w]
        fit = [x for x in raw if least <= len(x[1]) < most]
        sparse = [level_of(len(b) - w + 1) == LEVELS[-1] for _, b in fit]  # those of one level only need no others worked out
        for kind in (False, True):
            for numbers, data, at in _blocks([x for x, s in zip(fit, sparse, strict=True) if s == kind]):
                for i, chains in zip(numbers, _chains(data, at, w, rank), strict=True):
                    out[i][w] = chains
    return out


def _filter_text(bits: np.ndarray) -> str:
    """The filter's bytes, or the places of its bits after a tilde where that is shorter."""
    places = np.flatnonzero(bits).astype("<u2").tobytes()
    packed = np.packbits(bits).tobytes()
    return "~" + base64.b64encode(places).decode() if len(places) + 2 < len(packed) else base64.b64encode(packed).decode()


def _filter_of(s: str) -> np.ndarray:
    raw = base64.b64decode(s.removeprefix("~"))
    if not s.startswith("~"):
        return np.unpackbits(np.frombuffer(raw, np.uint8))
    out = np.zeros(BITS, np.uint8)
    out[np.frombuffer(raw, "<u2")] = 1
    return out


def to_text(made: Print) -> str:
    return ";".join(f"{w}.{level}=" + ":".join(map(_filter_text, made[w][level])) for w in sorted(made) for level in sorted(made[w]))


def from_text(s: str) -> Print:
    out: Print = {}
    for chain in s.split(";") if s else []:
        name, filters = chain.split("=", 1)
        w, level = map(int, name.split("."))
        out.setdefault(w, {})[level] = np.array([_filter_of(x) for x in filters.split(":")], np.uint8)
    return out


def chain_likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1, dtype=np.float32)[:, None], b.sum(1, dtype=np.float32)[None, :]
    shared = a.astype(np.float32) @ b.astype(np.float32).T
    chance, most = na * nb / BITS, np.minimum(na, nb)
    floor = chance + 0.1 * (most - chance)
    score = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1)
    weight = a.sum(1, dtype=np.float64)
    return float(min(1.0, (score.max(1) * weight).sum() / weight.sum()))


def _same(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> bool:
    return a.keys() == b.keys() and all(np.array_equal(a[x], b[x]) for x in a)


def likeness(a: Print, b: Print) -> float:
    if a.keys() == b.keys() and all(_same(a[w], b[w]) for w in a):
        return 1.0
    total = weight = 0.0
    for w in a.keys() & b.keys():
        level = max(min(a[w]), min(b[w]))
        if level in a[w] and level in b[w]:
            x, y = a[w][level], b[w][level]
            bits = w * float(min(x.sum(), y.sum()))
            total, weight = total + bits * chain_likeness(x, y), weight + bits
    return min(1.0, total / weight) if weight else 0.0


def _bucket(c: Column, starts: list[int]) -> Column:
    """Which range a doc_id falls into: binary search in the ranges' least ids, by expressions."""
    bounds = F.lit(starts).cast("array<bigint>")
    steps = [1 << k for k in range(max(len(starts) - 1, 1).bit_length() - 1, -1, -1)]
    at = F.lit(0)
    found = F.aggregate(F.array(*map(F.lit, steps)), at, lambda lo, s: F.when(F.coalesce(F.get(bounds, lo + s) <= c, F.lit(False)), lo + s).otherwise(lo))
    return F.coalesce(found, F.lit(0))


def chained(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in partitions by falling doc_id, each range followed by its next document: doc_id, text, bucket, ghost.

    Only the least and greatest doc_id of each range come to the driver; the texts are shuffled once. A null doc_id comes last."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = parallelism(spark)  # each partition gets a few ranges, which evens out their sizes
    ids = docs.select(key.alias("k"))
    rows = ids.repartitionByRange(min(4 * n, MOST_RANGES), "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("least"), F.max("k").alias("most")).collect()
    ranges = sorted((r["least"], r["most"]) for r in rows)
    starts, heads = [a for a, _ in ranges], [b for _, b in ranges]
    df = docs.withColumn("k", key).withColumn("bucket", _bucket(F.col("k"), starts))
    if not ranges:
        return df.withColumn("ghost", F.lit(False))
    # the first document of range b follows the last of range b + 1; the very first follows the very last
    first = df.filter(F.col("k").isin(heads)).groupBy("k").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("x"), F.min("bucket").alias("bucket"))
    first = first.select(F.when(F.col("k") > F.lit(-(1 << 63)), F.col("k")).alias("doc_id"), "x.text", "k", F.pmod(F.col("bucket") + 1, F.lit(len(ranges))).alias("bucket"), F.lit(True).alias("ghost"))
    both = df.withColumn("ghost", F.lit(False)).unionByName(first)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("k"), F.asc_nulls_first("text"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last third is replaced by the first of the next document, by falling doc_id."""
    ranks = ranks_of(count_steps(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(column(b, "doc_id"), column(b, "text"), column(b, "bucket"), column(b, "ghost"), strict=True)

        before: list[tuple] = []
        for block in blocks_of(rows(), lambda r: 4 * len(r[1] or ""), 8 * BLOCK):
            block = before + block
            before = block[-1:]
            texts = [r[1] or "" for r in block]
            edited = []
            for r, own, after in zip(block, texts, texts[1:], strict=False):
                k = len(own) // 3
                edited.append(own[: len(own) - k] + after[:k] if not r[3] else "")
            prints = fingerprints_of(texts + edited, ranks)
            out = []
            for i, (doc, _, _, ghost) in enumerate(block[:-1]):
                if not ghost:
                    own, other = prints[i], prints[len(texts) + i]
                    out.append((doc, len(texts[i]), sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(other), likeness(own, other), likeness(own, prints[i + 1])))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            if out:
                yield pa.record_batch([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return chained(docs).select("doc_id", "text", "bucket", "ghost").mapInArrow(run, SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
