import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import codes as C


def brute(rows, parts=8, entries=16, rounds=6):
    """vec_id -> all of the contract, by plain loops."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(part(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out, totals = {}, {}
    for i, v, lab in kept:
        found = [near(part(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab)
        totals[lab] = totals.get(lab, 0) + out[i][1]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (code, err, totals[lab], sha) for i, (code, err, lab) in out.items()}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 20), st.integers(0, 6), st.integers(0, 2**32 - 1))
def test_pruning_finds_what_all_entries_give(n, spread, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-(10**spread), 10**spread + 1, (n, 3)), rng.integers(-(10**spread), 10**spread + 1, (50, 3))
    index, d, seen = C.nearest(x, book)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and (seen <= n).all()


def test_annuli_leave_entries_out():
    rng = np.random.default_rng(1)
    book = rng.normal(size=(16, 8)) * np.arange(1, 17)[:, None]
    seen = C.nearest(C.integers(book[rng.integers(0, 16, 1000)] + rng.normal(size=(1000, 8)) * 0.1), C.integers(book))[2]
    assert seen.mean() < 5


def rows_of(n, seed=5):
    rng = random.Random(seed)
    rows = [(i * 7 % (n * 2), [rng.choice([-1, 1]) * rng.random() ** 3 for _ in range(16)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows[1] = (rows[1][0], rows[0][1], 0)
    rows[2] = (rows[2][0], [0.0] * 16, None)
    bad = [None, [None] + [0.0] * 15, [math.nan] + [0.0] * 15, [-math.inf] + [0.0] * 15]
    return rows + [(10_000 + k, v, 1) for k, v in enumerate(bad)] + [(-1, None, 0)]


@pytest.mark.parametrize("n", [1, 9, 300])
def test_query_against_brute_force(spark, tmp_path, n):
    rows = rows_of(max(n, 3))[:n] if n < 300 else rows_of(n)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in C.op11_vector_codes(spark, str(tmp_path)).collect()}
    assert got == brute(as_float)


def test_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<double>, label string, code int, vec int"
    odd = [(None, [1e30] * 8, "a", 1, 1), (3, [0.5] * 8, None, 1, 1), (3, [0.5] * 8, None, 1, 1), (3, [0.25] * 8, None, 1, 1), (4, [0.5] * 7, "b", 1, 1), (5, [], "b", 1, 1)]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(C.op11_vector_codes(spark, str(tmp_path)).collect(), key=repr)
    assert len(got) == 4 and all(r["error"] == 0 for r in got)
    assert sorted(r["code"] for r in got) == ["00" * 8, "01" * 8, "01" * 8, "03" * 8]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/empty/embeddings.parquet")
    assert C.op11_vector_codes(spark, f"{tmp_path}/empty").count() == 0
    short = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(5)], "vec_id long, embedding array<double>, label int")
    assert {r["code"][:14] for r in C.compress(short)[0].collect()} >= {"00" * 7}
