import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import runs as R


def brute(w):
    """All runs by trying every period at every place."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                best.setdefault((s, i + q), q)  # smaller periods come first
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_few_words(w):
    assert R.runs_of(w) == brute(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 6)), max_size=8))
def test_runs_of_repeated_parts(parts):
    w = [x for p, n in parts for x in p * n]
    assert R.runs_of(w) == brute(w)


def test_nested_overlapping_and_adjacent_runs():
    inner = [1] * 12 + [2]
    for w in (inner * 3, [1, 2] * 8 + [2, 1] * 8, list(range(9)) * 2 + list(range(9, 14)) * 4, [0] * 500, list(range(40)), list(range(30)) * 2, list(range(5)) * 2):
        assert R.runs_of(w) == brute(w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_z_function(s):
    expected = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    assert R.z_function(s) == expected


def texts():
    rng = random.Random(3)
    line = "it was so and so again "
    word = lambda: "".join(rng.choice("abcé \x1c") for _ in range(2))
    out = [None, "", " \t\r\n", "one", line * 9, "x y " * 40, "a" * 1_000_000, "b " * 300_000, " ".join(str(i) for i in range(100_000)) + " end" * 50]
    return out + [" ".join(rng.choice("ab") if rng.random() < 0.9 else word() for _ in range(rng.randint(1, 200))) for _ in range(150)]


def expected(doc_id, text):
    words = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    rows += [rows[20], (None, "a b " * 10, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    rewritten = 0
    for doc_id, text, *_ in rows:
        r = by_id[doc_id]
        words = expected(doc_id, text) if doc_id is not None else text.encode().split()
        rewritten += doc_id is not None and words != (text or "").encode().split()
        if len(words) > 5000:
            continue
        runs = brute(words)
        assert r["n_runs"] == len(runs) and r["n_words"] == len(words)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = [x for i, x in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
    assert rewritten > 5
    assert (by_id[7]["n_runs"], by_id[7]["length"], by_id[7]["period"]) == (1, 300_000, 1)
    assert (by_id[8]["start"], by_id[8]["length"]) == (100_000, 50)


def test_operator_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("w " * 14 + "z", 1, "r")], "text string, runs int, row string")
    clashing = tuple(R.periodic_runs(df).first())
    assert clashing[:2] == (1, "r") and clashing[2] == 15 and clashing[4] == "w z" and [tuple(x) for x in clashing[3]] == [(0, 14, 1)]
    assert R.periodic_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [50_000])
def test_time_grows_with_n_log_n(n):
    w = [i % 97 for i in range(n)]
    assert R.runs_of(w) == [(0, n, 97)]
