import hashlib
import math
from collections import Counter

import numpy as np

from tessera.llm import fingerprints as P

WORDS = "the quick onyx goblin jumps over a lazy dwarf sphinx of black quartz judge my vow pack five dozen liquor jugs".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(rng.integers(100)) if rng.random() < 0.3 else "") for i in rng.integers(0, len(WORDS), n))


TEXTS = {9: None, 8: "", 7: "short", 6: prose(1, 20), 5: prose(2, 400), 4: "é😀" * 300 + prose(3, 100), 3: prose(4, 6000), 2: prose(5, 400), 1: "x" * 3000, 0: prose(2, 400)}


def brute_step(window):
    c = Counter(window)
    total = sum(round(n * math.log2(n) * 65536) if n > 1 else 0 for n in c.values())
    return int(min(max((math.log2(len(window)) - total / (65536 * len(window))) * ((P.STEPS - 1) / math.log2(len(window))), 0), P.STEPS - 1))


def test_entropy_steps_equal_counting():
    for w in P.SCALES:
        data = np.frombuffer(prose(7, 60).encode() + b"a" * 50, np.uint8)
        got = P.entropy_steps(data, w)
        assert got.tolist() == [brute_step(data[i : i + w].tobytes()) for i in range(len(data) - w + 1)]


def brute_features(b, w, rank):
    """Each run of R windows in turn votes for the leftmost of its rarest: the features of each level the text has."""
    windows = [b[i : i + w] for i in range(len(b) - w + 1)]
    steps = [rank[brute_step(x)] for x in windows]
    levels = {}
    for r in (1, 8, 16, 32):
        votes = Counter(min(range(i, i + r), key=lambda k: (steps[k], k)) for i in range(len(windows) - r + 1))
        levels[r] = list(dict.fromkeys(windows[k] for k in range(len(windows)) if votes[k] >= r / 4))
    least = max(r for r in levels if (r == 1 or 32 * r <= len(windows)) and levels[r])
    return {r: found for r, found in levels.items() if r >= least and found}


def brute_hash(window):
    h = (0x9E3779B97F4A7C15 + len(window)) % 2**64
    padded = window.ljust(-(-len(window) // 8) * 8, b"\0")
    for i in range(0, len(padded), 8):
        h = (h ^ int.from_bytes(padded[i : i + 8], "little")) * 0xFF51AFD7ED558CCD % 2**64
        h ^= h >> 32
    h = h * 0xC4CEB9FE1A85EC53 % 2**64
    return h ^ (h >> 29)


def brute_print(text, ranks):
    b = (text or "").encode()
    b = b"\0" + b if len(b) == 1 else b
    out = {}
    for w, (least, most) in {2: (1, 64), 8: (8, 1024), 32: (32, math.inf)}.items():
        if b and least <= len(b) < most:
            out[w] = {}
            for level, found in brute_features(b, w, ranks[w]).items():
                out[w][level] = np.zeros((-(-len(found) // P.PER_FILTER), P.BITS), np.uint8)
                for i, x in enumerate(found):
                    for k in range(P.HASHES):
                        out[w][level][i // P.PER_FILTER, brute_hash(x) // 2 ** (11 * k) % P.BITS] = 1
    return out


def plain(made):
    return {w: {level: c.tolist() for level, c in chains.items()} for w, chains in made.items()}


def brute_likeness(a, b):
    """Shared bits less those of chance and a tenth, over the most there could be, by the best filter, on the larger least level; mean over lengths by bits times length."""
    a, b = plain(a), plain(b)
    if a == b:
        return 1.0
    sums = [0.0, 0.0]
    for w in set(a) & set(b):
        level = max(min(a[w]), min(b[w]))
        if level not in a[w] or level not in b[w]:
            continue
        x, y = sorted((a[w][level], b[w][level]), key=len)
        total = weight = 0.0
        for f in x:
            best = 0.0
            for g in y:
                chance, most = sum(f) * sum(g) / P.BITS, min(sum(f), sum(g))
                floor = chance + 0.1 * (most - chance)
                best = max(best, min(1.0, (sum(p & q for p, q in zip(f, g, strict=True)) - floor) / (most - floor)))
            total, weight = total + best * sum(f), weight + sum(f)
        bits = w * min(sum(map(sum, x)), sum(map(sum, y)))
        sums = [sums[0] + bits * total / weight, sums[1] + bits]
    return sums[0] / sums[1] if sums[1] else 0.0


def test_likeness_equals_brute_force():
    ranks = {w: np.random.default_rng(w).permutation(P.STEPS) for w in P.SCALES}
    texts = ["", "a", "b", "ab", prose(1, 3), prose(1, 9), prose(1, 20), prose(1, 21), prose(2, 60), prose(2, 400), prose(2, 380) + prose(3, 30), "x" * 300, prose(4, 900)]
    made = P.fingerprints_of(texts, ranks)
    for a in made:
        for b in made:
            assert abs(P.likeness(a, b) - brute_likeness(a, b)) < 1e-5


def test_one_character_less_stays_alike():
    """At every length from 8 to 300 characters, of one to four bytes each, at the end and at the beginning."""
    bases = [prose(k, 90) for k in range(6)] + ["".join(chr(c) for c in np.random.default_rng(k).integers(lo, lo + 40, 310)) for k, lo in enumerate((0x61, 0x430, 0x4E00, 0x1F300))]
    texts = [t for base in bases for n in range(7, 301) for t in (base[:n], base[1:n])]
    counts = {w: sum(np.bincount(P.entropy_steps(np.frombuffer(b.encode(), np.uint8), w), minlength=P.STEPS) for b in bases) for w in P.SCALES}
    ranks = P.ranks_of(counts)
    made = dict(zip(texts, P.fingerprints_of(texts, ranks), strict=True))
    for base in bases:
        for n in range(8, 301):
            assert P.likeness(made[base[:n]], made[base[: n - 1]]) > 0.8, (n, base[:9])
            assert P.likeness(made[base[:n]], made[base[1:n]]) > 0.8, (n, base[:9])


def test_likeness_of_a_beginning_does_not_jump_with_length():
    """The first n characters against the first n / 2 and the first 8n, for every n from 20 to 300: means over texts."""
    bases = [prose(k, 700)[:2400] for k in range(20, 32)]
    counts = {w: sum(np.bincount(P.entropy_steps(np.frombuffer(b.encode(), np.uint8), w), minlength=P.STEPS) for b in bases) for w in P.SCALES}
    ranks = P.ranks_of(counts)
    lengths = range(20, 301)
    wanted = sorted({m for n in lengths for m in (n // 2, n, 8 * n)})
    made = [dict(zip(wanted, P.fingerprints_of([b[:m] for m in wanted], ranks), strict=True)) for b in bases]
    for other in (lambda n: n // 2, lambda n: 8 * n):
        means = [np.mean([P.likeness(m[n], m[other(n)]) for m in made]) for n in lengths]
        assert min(means) > 0.9
        assert np.abs(np.diff(means)).max() < 0.1


def test_levels_are_nested_and_a_passage_keeps_its_features():
    ranks = {w: np.random.default_rng(w).permutation(P.STEPS) for w in P.SCALES}
    b = prose(40, 300).encode()
    for w in P.SCALES:
        whole = brute_features(b, w, ranks[w])
        for part in (b[:90], b[100:190], b[-400:]):
            found = brute_features(part, w, ranks[w])
            assert all(set(found[r]) <= set(found[q]) for q in found for r in found if q < r)
            assert all(set(found[r]) <= set(whole[r]) for r in found if r in whole)


def test_steps_are_counted_over_all_windows(spark):
    texts = [t for t in TEXTS.values() if t and len(t) < 500] + ["a", "ab"]
    got = P.count_steps(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"))
    for w in P.SCALES:
        raw = [t.encode() if len(t) > 1 else b"\0" + t.encode() for t in texts]
        assert {k: n for k, n in enumerate(got[w].tolist()) if n} == Counter(brute_step(b[i : i + w]) for b in raw for i in range(len(b) - w + 1))


def test_very_long_texts():
    ranks = {w: np.arange(P.STEPS) for w in P.SCALES}
    for t in (" " * 1_000_000 + "a", "a." * 2_000_000, prose(3, 200_000), "é" * 1_000_000):
        (f,) = P.fingerprints_of([t], ranks)
        assert list(f) == [32] and len(f[32])


def test_a_text_has_the_same_fingerprint_in_any_block():
    texts = [t for t in TEXTS.values() if t]
    ranks = {w: np.random.default_rng(w).permutation(P.STEPS) for w in P.SCALES}
    together = P.fingerprints_of(texts, ranks)
    for t, f in zip(texts, together, strict=True):
        assert P.to_text(P.fingerprints_of([t], ranks)[0]) == P.to_text(f) == P.to_text(P.from_text(P.to_text(f))) != ""
        assert plain(f) == plain(brute_print(t, ranks))


def test_short_texts_that_differ_only_at_the_end_differ():
    ranks = P.ranks_of({w: np.zeros(P.STEPS, np.int64) for w in P.SCALES})
    for n in range(17, 46):
        head = prose(n, 20)[: n - 1]
        for a, b in ((head + "@", head + "#"), ("д" * (n - 1) + "я", "д" * (n - 1) + "ю")):
            x, y = P.fingerprints_of([a, b], ranks)
            assert P.likeness(x, y) < 1, (a, b)


def test_tied_windows_of_longer_texts_are_all_kept():
    ranks = {w: np.zeros(P.STEPS, np.int64) for w in P.SCALES}
    cycle = "".join(chr(c) for c in range(33, 97))
    for n in (60, 127, 128, 400):
        whole = (cycle * 7)[: n - 1]
        x, y = P.fingerprints_of([whole + "~", whole + "}"], ranks)
        assert P.likeness(x, y) < 1


def run(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, bucket string").write.parquet(path + "/documents.parquet")
    return P.op1_fingerprints(spark, path).collect()


def test_rows(spark, tmp_path):
    rows = {r["doc_id"]: r for r in run(spark, [(i, t, "b") for i, t in TEXTS.items()], str(tmp_path))}
    order = sorted(TEXTS, reverse=True)
    assert sorted(rows) == sorted(TEXTS)
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        own, other = TEXTS[here] or "", TEXTS[after] or ""
        k = len(own) // 3
        edited = own[: len(own) - k] + other[:k]
        r = rows[here]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert abs(r["near_next"] - P.likeness(P.from_text(r["fingerprint"]), P.from_text(rows[after]["fingerprint"]))) < 1e-9
        assert abs(r["near_edited"] - P.likeness(P.from_text(r["fingerprint"]), P.from_text(r["edited_fingerprint"]))) < 1e-9
    assert rows[5]["fingerprint"] == rows[0]["fingerprint"]
    assert all(rows[i]["near_edited"] > rows[i]["near_next"] + 0.3 for i in (5, 3, 2))


def test_many_ranges_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(i % 97 if i % 50 else None, prose(i, 5 + i % 40), "") for i in range(300)]
    got = run(spark, rows, str(tmp_path))
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -math.inf), r[1]))
    want = []
    for i, (doc, t, _) in enumerate(order):
        k = len(t) // 3
        want.append((doc, hashlib.sha256((t[: len(t) - k] + order[(i + 1) % len(order)][1][:k]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)


def test_one_and_none(spark, tmp_path):
    (r,) = run(spark, [(4, prose(1, 90), "")], str(tmp_path / "a"))
    assert r["near_next"] == 1.0
    assert run(spark, [], str(tmp_path / "b")) == []
