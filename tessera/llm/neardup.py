"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation, connected components.

A document's set is that of its distinct shingles of five words (runs of anything but white space, A-Z lower-cased), as 64-bit
hashes. Equal sets are one class; the class's least doc_id stands for it. Representatives with an equal band of their MinHash
signatures meet in a bucket. Every candidate pair goes through signature batches of BATCH values: after each batch it is dropped
if, for a uniform prior, the posterior probability of a similarity of SIMILARITY or more is below MISS. Survivors are compared on
their full sets, and only confirmed pairs are links.

No bucket emits all its pairs. First each member is compared with one least member of its buckets, the one it shares most bands
with, and the links found are drawn together into components. Then the buckets that still hold several components are taken up.
Their members are dealt into cells of bounded size, those of the bucket's largest component apart from the others: pairs within
that component are connected already, so its cells never meet each other, only cells of other members. Cells hold signatures; each
pair of cells is pruned in one place by arrays and names the members that some survivor needs. Only those are dealt once more, now
with their texts, and compared on their full sets; what comes out is a forest of links, at most one per member. So every pair of a
bucket is either pruned, compared or already connected. Written steps that nothing reads any more are deleted.

A text is read with two tables of powers, of 8 bytes for each byte of the worker's longest text, rounded up to a power of two.

Defined results: a document without words (null or empty text) has 0 shingles, is linked with nothing and is its own component;
repeated rows get equal results; rows of one doc_id with different texts are one vertex where both stand for their classes; a null
doc_id belongs to its class's component and is kept only if the class has no doc_id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, column, discard, materialize, parallelism, table

WORDS, SIMILARITY = 5, 75  # words of a shingle; the least similarity in hundredths
BANDS, ROWS, BATCH, MISS = 32, 4, 16, 1e-6
CELL = 512
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20_240_607)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
FACTOR, SHIFT = _rng.integers(1, 1 << 32, HASHES, np.uint32) | np.uint32(1), _rng.integers(1, 1 << 32, HASHES, np.uint32)
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, for positions below n."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def shingles(text: str | None) -> np.ndarray:
    """The document's set, as sorted 64-bit hashes: of the bytes of its words with single spaces between."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    raw = np.frombuffer(data, np.uint8)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    k = min(WORDS, len(starts)) - 1
    starts, ends = starts[: len(starts) - k], ends[k:]
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(h ^ (h >> np.uint64(33)))


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima, of which the upper 16 bits are kept after a last mix."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):
        np.minimum(least, (h[i : i + 4096, None] * FACTOR + SHIFT).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def least_matches() -> list[tuple[int, int]]:
    """(values compared, matches that a pair must have by then). With m of n equal the posterior is Beta(m+1, n-m+1), so a similarity of t or more has the probability that of n+1 draws at t at most m succeed."""
    t, out = SIMILARITY / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < MISS:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


BOUNDS = least_matches()


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the paired signatures (rows) are never pruned."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, need in BOUNDS:
        matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
        alive = alive[matches[alive] >= need]
    ok = np.zeros(len(a), bool)
    ok[alive] = True
    return ok


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def describe(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, same (of the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in blocks_of(zip(column(b, "doc_id"), column(b, "text"), strict=True), lambda r: 300 + len(r[1] or ""), 8_000_000):
                sets = [shingles(t) for _, t in rows]
                yield pa.record_batch(
                    [
                        pa.array([i for i, _ in rows], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "same", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, same binary, signature binary")


def _near_sizes(a: str, b: str) -> F.Column:
    """Sizes that allow the similarity at all."""
    return (F.col(a) * 100 >= F.col(b) * SIMILARITY) & (F.col(b) * 100 >= F.col(a) * SIMILARITY)


def _signatures(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(column(b, name)), "<u2").reshape(b.num_rows, HASHES)


def prune(pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    """pairs(a, b) that survive the batches of their signatures."""
    of = lambda x: representatives.select(F.col("node").alias(x), F.col("signature").alias(f"signature_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(survives(_signatures(b, "signature_a"), _signatures(b, "signature_b"))))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) whose full sets are similar enough. texts(doc_id, text) holds the documents of the pairs."""
    of = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(shingles(ta), shingles(tb)) for ta, tb in zip(column(batch, "text_a"), column(batch, "text_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, component (its least node), for all nodes in links. Alternates large-star and small-star steps, which halve paths, until nothing changes; neighbours are never gathered in a row."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before, made = None, []
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")).distinct()
        made.append(edges)
        edges = materialize(small, "small")
        discard(*made)
        made = []
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _facing(x: int, first: np.ndarray | None, comp: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows of a pair of cells row x is to be compared with: later ones of its own cell (first is None), else those of the other cell (first: rows of one); of another component and of a like size."""
    ok = (comp != comp[x]) & (n * 100 >= n[x] * SIMILARITY) & (n[x] * 100 >= n * SIMILARITY)
    return np.flatnonzero(ok & ((np.arange(len(n)) > x) if first is None else (~first if first[x] else False)))


def cell_survivors(comp: np.ndarray, sig: np.ndarray, n: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """Rows of a pair of cells that are in a pair which is never pruned."""
    needed = np.zeros(len(comp), bool)
    for x in range(len(comp)):
        y = _facing(x, first, comp, n)
        if len(y):
            alive = y[survives(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y])]
            needed[alive] = True
            needed[x] |= bool(len(alive))
    return np.flatnonzero(needed)


def cell_links(node: np.ndarray, comp: np.ndarray, sig: np.ndarray, n: np.ndarray, first: np.ndarray | None, texts: list[str]) -> list[tuple[int, int]]:
    """Links between different components among the rows of a pair of cells: pairs that survive are compared on full sets; a pair that earlier links connect is left out."""
    top = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    sets: dict[int, np.ndarray] = {}

    def set_of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(texts[k])
        return sets[k]

    out = []
    for x in range(len(node)):
        y = _facing(x, first, comp, n)
        if not len(y):
            continue
        for k in y[survives(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y])].tolist():
            cx, ck = root(int(comp[x])), root(int(comp[k]))
            if cx != ck and similar(set_of(x), set_of(k)):
                top[max(cx, ck)] = min(cx, ck)
                out.append((int(min(node[x], node[k])), int(max(node[x], node[k]))))
    return out


def _deal(members: DataFrame) -> DataFrame:
    """members(bucket, node, n, component, signature) of open buckets -> the same by pairs of cells (i, j), with own.

    Cells 0, 1, ... hold the members outside the bucket's largest component, cells -1, -2, ... that component; a pair of cells has
    at least one of the former, so its rows are others x all, not all x all."""
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    shape = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("largest"), F.sum("k").alias("m"))
    count = lambda k: F.ceil(k / CELL).cast("int")
    shape = shape.select("bucket", F.col("largest.component").alias("main"), count(F.col("largest.k")).alias("mains"), count(F.col("m") - F.col("largest.k")).alias("others"))
    main, hashed = F.col("component") == F.col("main"), F.xxhash64("node")
    own = F.when(main, -1 - F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int")
    across = F.sequence(F.lit(0), F.col("others") - 1)
    met = F.when(main, across).otherwise(F.concat(across, F.sequence(-F.col("mains"), F.lit(-1))))
    dealt = members.join(shape, "bucket").withColumn("own", own).withColumn("other", F.explode(met))
    return dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "component", "signature")


def _by_cells(dealt: DataFrame, fields: tuple[str, ...], schema: str, one) -> DataFrame:
    """one(rows, first, node, comp, sig, n) for each pair of cells; first as in _facing."""
    dealt = dealt.repartition(parallelism(dealt.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def made(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        if len(rows) > 1:
            first = np.array([r[1] == r[3] for r in rows]) if rows[0][1] != rows[0][2] else None
            n, node, comp = (np.array([r[k] for r in rows], np.int64) for k in (5, 4, 6))
            sig = np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(len(rows), HASHES)
            found = one(rows, first, node, comp, sig, n)
        names = [c.split() for c in schema.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32()}
        return pa.record_batch([pa.array([f[k] for f in found], kinds[kind]) for k, (_, kind) in enumerate(names)], names=[c for c, _ in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            for r in zip(*(column(b, f) for f in fields), strict=True):
                if group and group[0][:3] != r[:3]:
                    yield made(group)
                    group = []
                group.append(r)
        if group:
            yield made(group)

    return dealt.mapInArrow(run, schema)


FIELDS = ("bucket", "i", "j", "own", "node", "n", "component", "signature")


def _cells(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members of open buckets -> links(a, b) between different components, confirmed on texts(node, text)."""
    dealt = _deal(members)
    needed = _by_cells(dealt, FIELDS, "bucket long, i int, j int, node long", lambda rows, first, node, comp, sig, n: [(*rows[k][:3], rows[k][4]) for k in cell_survivors(comp, sig, n, first).tolist()])
    needed = materialize(needed, "needed")
    some = dealt.join(needed, ["bucket", "i", "j", "node"], "left_semi").join(texts, "node").select(*FIELDS, "text")
    return _by_cells(some, (*FIELDS, "text"), "a long, b long", lambda rows, first, node, comp, sig, n: cell_links(node, comp, sig, n, first, [r[8] for r in rows])).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    described = materialize(describe(docs), "described")
    classes = described.filter("n > 0 AND doc_id IS NOT NULL").groupBy("same").agg(F.min(F.struct("doc_id", "n", "signature")).alias("r"))
    classes = materialize(classes.select("same", F.col("r.doc_id").alias("node"), "r.n", "r.signature"), "classes")
    representatives = classes.select("node", "n", "signature")
    bands = representatives.select(F.posexplode(F.array(*[F.substring("signature", 2 * ROWS * k + 1, 2 * ROWS) for k in range(BANDS)])).alias("band", "value"), "node", "n")
    bands = bands.select(F.xxhash64("band", "value").alias("bucket"), "node", "n")
    heads = bands.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("m")).filter("m > 1")
    met = materialize(bands.join(heads, "bucket").select("bucket", "m", "node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")), "met")
    # one dealing of the texts, at every size the same way, serves both comparisons
    texts = materialize(docs.join(met.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    shared = met.filter(F.col("node") != F.col("head")).filter(_near_sizes("n", "head_n")).groupBy("node", "head").count()
    first = shared.groupBy("node").agg(F.max(F.struct("count", (-F.col("head")).alias("low"))).alias("best")).select((-F.col("best.low")).alias("a"), F.col("node").alias("b"))
    links = materialize(confirm(prune(first, representatives), texts), "confirmed")
    label = components(links)
    left = met.join(label, "node", "left").select("bucket", "m", "node", "n", F.coalesce("component", "node").alias("component"))
    open_ = left.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    members = left.join(open_, "bucket", "left_semi").join(representatives.select("node", "signature"), "node")
    members = materialize(members.select("bucket", "node", "n", "component", "signature"), "members")
    more = materialize(_cells(members, texts.withColumnRenamed("doc_id", "node")), "more")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    discard(met, texts, members)
    named = described.select("doc_id", "n", "same").join(classes.select("same", "node"), "same", "left").join(label, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') sh FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id d, doc_id k FROM documents UNION SELECT e.y, r.k FROM r JOIN e ON e.x = r.d),
t AS (SELECT d, min(k) k FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) n_shingles, t.k component_id, doc_id = t.k kept FROM documents JOIN t ON t.d = doc_id LEFT JOIN n USING (doc_id)
"""
