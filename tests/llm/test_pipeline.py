import numpy as np

import corpus_pipeline as C
from tests.llm.test_neardup import brute
from tests.llm.test_packing import brute_pieces, whole

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = steps["language"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not any(ch.isalpha() for ch in r["text"] or "")}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    before, after = steps["near_duplicates"]
    label = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, top) in label.items() if i == top)
    before, after = steps["personal_data"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    old = {r["doc_id"]: r["text"] for r in before}
    changed = [r for r in after if r["text"] != old[r["doc_id"]]]
    assert changed and all(r["n_chars"] == len(r["text"]) for r in changed)
    assert all(any(ch in old[r["doc_id"]] for ch in "0123456789@") for r in changed)
    before, after = steps["packing"]
    order = sorted(r["doc_id"] for r in before)
    texts = {r["doc_id"]: r["text"] for r in before}
    want = brute_pieces([texts[i] for i in order])
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in after} == {(order[k], p): v for (k, p), v in want.items()}
    assert whole(after) <= np.ceil(sum(r["length"] for r in after) / 2048) + 1


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, kept string, score double"
    rows = [(1, "the cat sat with the dog here", "en", "s", 29, 1, "k", 0.5)] * 2 + [(2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, "k", 0.0), (None, "the cat a@b.co and the dog there", None, None, 28, 2, None, None)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = C.run(spark, f"{tmp_path}/some").collect()
    assert sorted([r["doc_id"] for r in got], key=repr) == [1, None]
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c = "one two three four five six", "some quite other words stand here", "these are words of a third text"
    docs = spark.createDataFrame([(None, a, 1), (7, a, 2), (7, b, 3), (7, b, 4), (None, c, 5), (None, c, 6), (3, None, 7), (3, "", 8)], "doc_id long, text string, at int")
    got = sorted(((r["doc_id"], r["text"]) for r in C.near_duplicate(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(7, a), (7, b), (None, c), (3, None), (3, "")], key=repr)
