"""Vector codes: product quantisation whose nearest entries are found by annular pruning on norms.

Components become integers, floor(SCALE x). A vector is cut into PARTS consecutive parts, each with a codebook of ENTRIES entries that
starts as that part of the vectors of smallest id. In each of ROUNDS rounds every part goes to its nearest entry, and entries become the
floored means of their parts; then parts are assigned for good.

An entry at distance D or less has a norm within D of the part's own. A codebook is sorted by norm; the entry of nearest norm gives a
first distance, a binary search the interval of norms that this distance allows, both ends included, and only the entries of that annulus
are evaluated, exactly, in integers. Norms are roots in floating point, so the interval is widened by more than their error: no entry
that is as near is left out, and ties go to the lower index as they would without pruning.

A round is one scan: a task keeps one sum and count per part and entry, so that PARTS x ENTRIES rows leave it and as many reach the
driver, whatever the table's size. Vectors are never shuffled.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped, as are those that have not as many
components as the one of smallest id has, and empty ones; parts are cut at floor(d p / PARTS), so they are equal where PARTS divides d;
integers beyond LARGEST count as that, so that sums of squares stay exact; of equal ids the smaller vector comes first, null ids
come last; with fewer vectors than ENTRIES there are as many entries; repeated rows stay; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 26
SLICE = 20_000  # vectors whose distances stand in memory at once
Codebook = np.ndarray  # entries x components of a part


def cuts(d: int, parts: int = PARTS) -> list[slice]:
    return [slice(d * p // parts, d * (p + 1) // parts) for p in range(parts)]


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def nearest(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row of x (ties to the lower), its squared distance, and how many entries were evaluated."""
    norms = np.sqrt((book.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms, entries = norms[order], book[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    seed = np.searchsorted(norms, own).clip(1, len(norms) - 1) if len(norms) > 1 else np.zeros(len(x), np.int64)
    if len(norms) > 1:
        seed -= (own - norms[seed - 1]) <= (norms[seed] - own)
    best = ((x - entries[seed]) ** 2).sum(axis=1)
    index = order[seed]
    reach = np.sqrt(best.astype(np.float64)) + 1e-9 * (own + norms[-1]) + 1e-6
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    for j in range(len(norms)):
        rows = np.flatnonzero((low <= j) & (j < high) & (seed != j))
        if len(rows):
            d = ((x[rows] - entries[j]) ** 2).sum(axis=1)
            won = (d < best[rows]) | ((d == best[rows]) & (order[j] < index[rows]))
            rows, d = rows[won], d[won]
            best[rows], index[rows] = d, order[j]
    return index, best, high - low


def matrix(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten()
    return integers(flat.to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vec of the rows that count, all of one number of components."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.filter("vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vec").select(F.size("vec").alias("n")).first()
    return rows.filter(F.size("vec") == (first["n"] if first else 0))


def first_books(rows: DataFrame) -> list[Codebook]:
    """Every part's codebook from the vectors of smallest id."""
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(ENTRIES).select("vec").collect()
    if not least:
        return []
    x = integers(np.array([r["vec"] for r in least]))
    return [x[:, c] for c in cuts(x.shape[1])]


def means(rows: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                x = matrix(b.slice(i, SLICE))
                for p, c in enumerate(cuts(x.shape[1])):
                    index = nearest(x[:, c], books[p])[0]
                    counts[p] += np.bincount(index, minlength=len(books[p]))
                    np.add.at(sums[p], index, x[:, c])
        met = [(p, e, int(counts[p, e]), sums[p][e].tolist()) for p, e in np.argwhere(counts).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "sums"), m, strict=True)) for m in met], schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    partial = rows.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    width = max(b.shape[1] for b in books)
    sums = [F.sum(F.get("sums", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(width)]
    new = [b.copy() for b in books]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        book = new[r["part"]]
        book[r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(book.shape[1])]
    return new


def train(rows: DataFrame, rounds: int = ROUNDS) -> list[Codebook]:
    books = first_books(rows)
    for _ in range(rounds if books else 0):
        books = means(rows, books)
    return books


def encode(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """vec_id, label, code, error, and how many entries were evaluated for it."""
    schema = "code string, error long, evaluated long"
    made = pa.schema([("code", pa.string()), ("error", pa.int64()), ("evaluated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                x = matrix(part)
                found = [nearest(x[:, c], books[p]) for p, c in enumerate(cuts(x.shape[1]))]
                digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                columns = [pa.array([row.tobytes().hex() for row in digits], pa.string()), pa.array(sum(f[1] for f in found), pa.int64()), pa.array(sum(f[2] for f in found), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["vec_id", "label", *made.names])

    types = dict(rows.dtypes)
    return rows.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, {schema}")


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame) -> tuple[DataFrame, list[Codebook]]:
    """vectors(vec_id, embedding, label) -> codes (see encode) and codebooks."""
    rows = sound(vectors)
    books = train(rows)
    return encode(rows, books), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = materialize(codes, "codes")
    # a row a label: its written size tells Spark whether it can be broadcast, else skewed labels are split
    totals = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "totals").withColumnRenamed("label", "_label")
    whole = codes.join(totals, codes["label"].eqNullSafe(totals["_label"]))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round as common tables: distances to all entries of a part, the nearest, floored means."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""
d{k} AS (SELECT vec_id, r.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM r JOIN b{k} USING (p)),
n{k} AS (SELECT vec_id, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS nth FROM d{k}) WHERE nth = 1)""")
        if k < ROUNDS:
            rounds.append(f"""
s{k} AS (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM n{k} JOIN r USING (vec_id, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM r) + 1)) AS i) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)""")
    last = ROUNDS
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT vec_id, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM v, (SELECT unnest(range(0, {PARTS})) AS p)),
b0 AS (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM r) WHERE e < {ENTRIES}),{",".join(rounds)},
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(c, ',') AS t FROM b{last})),
f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{last} GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN v USING (vec_id) GROUP BY label)
SELECT f.vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN v ON f.vec_id = v.vec_id JOIN l ON l.label IS NOT DISTINCT FROM v.label, h
"""


OP11_SQL = _sql()
