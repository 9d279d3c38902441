import math
import zlib

import numpy as np
import pytest

from tessera.llm import language as L

SF = "/root/testdata/sf0.01"


def test_codewords():
    for n in (1, 2, 3, 4, 7, 9, 20):
        c = L.codewords(n)
        assert len(c) == n and (n == 1 or len({tuple(r) for r in c}) == n)
        assert all(abs(col.sum()) < n for col in c.T)
    assert L.codewords(4).shape == (4, 7)
    assert min(int((a != b).sum()) for i, a in enumerate(L.codewords(20)) for b in L.codewords(20)[:i]) >= 10


def test_grams_equal_plain_counting():
    texts = ["", "Ab1 é", "xyz" * 50]
    for numbers, slots, starts in L.grams(texts):
        ends = [*starts[1:], len(slots)]
        for k, i in enumerate(numbers):
            b = bytes(L.FOLD[list(b"  " + texts[i].encode() + b" ")])
            want = []
            for j in range(len(b) - 2):
                for order, value in ((2, b[j] << 8 | b[j + 1]), (3, b[j] << 16 | b[j + 1] << 8 | b[j + 2])):
                    want.append((value * 2654435761 + order * 40503) % 2**32 >> 18)
            assert slots[starts[k] : ends[k]].tolist() == want


def test_held_out_accuracy(spark):
    rows = L.op5_language_codes(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"] is not None]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_unlabelled_odd_and_repeated_texts(spark, tmp_path):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 34 !", "de"), (5, "", None), (6, "the dog", None), (6, "the dog", None), (None, "und die", None), (7, "x" * 300_000, None)]
    rows += [(100 + i, "the cat and the dog", "en") for i in range(9)] + [(200 + i, "der hund und die katze", "de") for i in range(9)]
    spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in L.op5_language_codes(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    said = {r[0]: r[2] for r in got}
    assert said[3] == said[4] == said[5] == "und" and said[6] == "en" and said[None] == "de" and said[7] in ("en", "de")


@pytest.mark.parametrize("labels", [[None, None], ["en", None]])
def test_no_or_one_language(spark, labels):
    df = spark.createDataFrame([(i, "abc", x) for i, x in enumerate(labels)], "doc_id long, text string, lang string")
    got = L.identify(df, L.learn(df), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in got} == {labels[0] or "und"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(df, L.learn(df), ["doc_id"]).count() == 0


def brute_slots(text):
    """Slots of the pairs and triples of a text's folded bytes, framed by two spaces and one."""
    b = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in b"  " + text.encode() + b" "]
    mix = lambda x, k: (x * 2654435761 + k * 40503) % 2**32 >> 18
    pairs = [mix(b[i] << 8 | b[i + 1], 2) for i in range(len(b) - 2)]
    return pairs + [mix((b[i] << 8 | b[i + 1]) << 8 | b[i + 2], 3) for i in range(len(b) - 2)]


def brute_predict(labelled, text):
    """Three bits of three languages: counts, log odds, trust, margins, losses and distances by plain loops."""
    languages = sorted({lang for lang, _ in labelled})
    code = L.codewords(len(languages)).tolist()
    share = []
    for lang in languages:
        n = [0.5] * L.SLOTS
        for own, t in labelled:
            if own == lang:
                for s in brute_slots(t):
                    n[s] += 1
        share.append([x / sum(n) for x in n])
    weights, trust = [], []
    for b in range(len(code[0])):
        side = lambda sign, b=b: [i for i in range(len(languages)) if code[i][b] == sign]
        mean = lambda who, s: sum(share[i][s] for i in who) / len(who)
        yes, no = side(1), side(-1)
        weights.append([math.log(mean(yes, s) / mean(no, s)) for s in range(L.SLOTS)])
        trust.append(sum((mean(yes, s) - mean(no, s)) * weights[b][s] for s in range(L.SLOTS)))
    trust = [t / (sum(trust) / len(trust)) for t in trust]
    found = brute_slots(text)
    margins = [sum(w[s] for s in found) / math.sqrt(len(found)) for w in weights]
    distance = [sum(math.log1p(math.exp(-c * m)) * t for c, m, t in zip(row, margins, trust, strict=True)) for row in code]
    near = [math.exp(min(distance) - d) for d in distance]
    best = distance.index(min(distance))
    return languages[best], near[best] / sum(near)


def test_predictions_equal_brute_force(spark):
    labelled = [("de", "der Hund und die Katze laufen über die Straße"), ("en", "the dog and the cat run over the street"), ("fr", "le chien et le chat courent dans la rue"), ("en", "THE bird sings"), ("de", "ein Vogel")]
    model = L.learn(spark.createDataFrame([(t, lang) for lang, t in labelled], "text string, lang string"))
    for t in ("the cat", "die Katze", "le chat", "Straße 7!", "x", "und the et"):
        lang, score, _ = model.predict([t])[0]
        want, sure = brute_predict(labelled, t)
        assert lang == want and abs(score - sure) < 1e-4, t


def test_many_languages_and_long_texts(spark, monkeypatch):
    """More languages than a task's tables hold, and texts of a million characters."""
    monkeypatch.setattr(L, "TABLES", 3)
    rows = [(f"{chr(97 + k)}{chr(98 + k)} " * 50, f"l{k}") for k in range(9)] + [("ab " * 350_000, "l0"), (" " * 1_000_000 + "a", "l0")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = L.learn(df)
    assert len(model.languages) == 9
    got = L.identify(df, model, ["text", "lang"]).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 10
