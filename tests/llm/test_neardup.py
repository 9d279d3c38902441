import numpy as np
import pytest

from tessera.llm import neardup as N


def brute_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (n, component): every pair is compared."""
    sets = [(i, brute_set(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def text(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def edited(rng, t, k):
    w = t.split(" ")
    for i in rng.integers(0, len(w), k):
        w[i] = f"e{rng.integers(1 << 30)}"
    return " ".join(w)


def corpus(seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(25):
        base = text(rng, int(rng.integers(3, 300)))
        out += [base] + [edited(rng, base, int(k)) for k in rng.integers(0, 9, int(rng.integers(1, 8)))]
    shared = text(rng, 60)
    out += [shared + " " + text(rng, int(k)) for k in rng.integers(5, 60, 25)]
    chain = text(rng, 120).split(" ")
    for i in range(12):  # each is like the next, the ends are not
        out.append(" ".join(chain[i * 6 : i * 6 + 60]))
    out += [None, "", " \t\n", "One two", "one  TWO\n", "a b c d", "x " * 20_000, "É a b c d e", "é a b c d e"]
    order = rng.permutation(len(out))
    return [(int(i) * 3, out[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("cell", [256, 4])
def test_equals_comparing_every_pair(spark, cell, monkeypatch):
    monkeypatch.setattr(N, "CELL", cell)
    rows = corpus(11)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, node long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in N.near_duplicates(df).collect())


def test_bounds_follow_the_posterior():
    rng = np.random.default_rng(1)
    s = rng.random(400_000)
    for n, need in N.BOUNDS[:2]:
        m = rng.binomial(n, s)
        rare = s[m == need - 1] >= 0.75
        assert rare.mean() < 0.001
    assert N.BOUNDS[-1][1] / N.HASHES > 0.5


def test_sets_and_signatures():
    for t in ("a b c d e f", "A  b\tc\x0bd e\n", "one", "é ü ö"):
        assert len(N.shingles(t)) == len(brute_set(t))
    rng = np.random.default_rng(3)
    a = N.shingles(text(rng, 400))
    b = np.union1d(a[: len(a) * 9 // 10], N.shingles(text(rng, 40)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((N.signature(a) == N.signature(b)).mean() - true) < 0.12


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (5, "other words stand here now"), (2, "other words stand here now")]
    got = sorted((tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True), (5, 1, 2, False), (2, 1, 2, True)], key=repr)
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_paths_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in N.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_a_large_open_bucket_of_several_components(spark, monkeypatch):
    """One bucket of thousands of members: a main component, two others, and members of none. Main cells never meet each other, and what is found is what all pairs give."""
    monkeypatch.setattr(N, "CELL", 64)
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 62, 400, np.uint64))
    sets = []
    for kind, many in ((0, 1500), (1, 300), (2, 200), (3, 200)):
        core = base if kind == 0 else np.union1d(base[: len(base) * 2 // 3], np.unique(np.random.default_rng(kind).integers(0, 1 << 62, 130, np.uint64)))
        for _ in range(many):
            own = core if kind < 3 else np.union1d(base[: len(base) // 2], rng.integers(0, 1 << 62, 200, np.uint64))
            sets.append((kind, np.unique(np.concatenate([own[3:], rng.integers(0, 1 << 62, 3, np.uint64)]))))
    order = rng.permutation(len(sets))
    rows = [(1, int(i), len(sets[k][1]), 10_000 + sets[k][0] if sets[k][0] == 0 else int(i), N.signature(sets[k][1]).tobytes()) for i, k in enumerate(order)]
    members = spark.createDataFrame([(b, i, n, c, bytearray(s)) for b, i, n, c, s in rows], "bucket long, node long, n long, component long, signature binary")
    dealt = N._deal(members)
    others, cells = 700, -(-1500 // 64)
    assert dealt.filter("i < 0 AND j < 0").count() == 0
    assert dealt.count() == 1500 * -(-others // 64) + others * (-(-others // 64) + cells)
    by_node = {int(i): sets[k][1] for i, k in enumerate(order)}
    monkeypatch.setattr(N, "similar", lambda a, b: True)
    pairs = N._by_cells(dealt, N.FIELDS, "bucket long, i int, j int, node long", lambda rows, first, node, comp, sig, n: [(*rows[k][:3], rows[k][4]) for k in N.cell_survivors(comp, sig, n, first).tolist()])
    needed = {r["node"] for r in pairs.collect()}
    monkeypatch.undo()
    linked = {i for i in by_node if any(k != i and rows[k][3] != rows[i][3] and N.similar(by_node[i], by_node[k]) for k in rng.integers(0, len(rows), 60).tolist())}
    assert linked <= needed


def test_very_long_texts_and_clashing_columns(spark):
    long = "a b " * 250_000
    rows = [(1, long, 1, b"x"), (2, long + "c", 1, b"x"), (3, " " * 1_000_000 + "a", 1, b"x"), (4, "x" * 1_000_000, 1, b"x"), (5, "x" * 999_999, 1, b"x"), (6, None, 1, b"x")]
    df = spark.createDataFrame([(i, t, n, bytearray(b)) for i, t, n, b in rows], "doc_id long, text string, component long, signature binary")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (3, 2), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (0, 6)}


def test_steps_are_deleted_and_the_folder_must_be_shared(spark, tmp_path):
    import os

    from tessera.sources import shared

    folder = shared.shared_dir(spark).replace("file:", "") + "/tessera"
    before = set(os.listdir(folder))
    N.near_duplicates(spark.createDataFrame(corpus(3), "doc_id long, text string")).collect()
    kept = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not kept & {"met", "texts", "members"}
