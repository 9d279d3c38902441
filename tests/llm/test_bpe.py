import hashlib
import random
import struct

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe as B

PATH = B.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
MERGES = B.Merges(PATH)
TEXTS = [
    None, "", " ", "the the cat's  \n\n hat", "Élan über 中文 😀 🇫🇷", "<|endoftext|>a <|endoftext|>", "<|endoftext", "a" * 5000, "ab" * 3000 + " " * 500, "\x00\x7f\u0085  x",
    "12 345 6.7e8", "THES!! REWH!!", "the the cat's  \n\n hat", "Ab***\t\tcd &amp; x_y\r\n" * 50,
]


def check(codec, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    ids = codec.encode([text])[0]
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
    assert codec.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.fixture(scope="module")
def lexicon(tmp_path_factory):
    words = sorted({w for t in TEXTS if t for w in MERGES.words.findall(t)})[::2] + [" walking", " talking", " walked", " talked", "walk"]
    path = tmp_path_factory.mktemp("x") / "lexicon"
    path.write_bytes(B.compile_lexicon({w.encode(): MERGES.merge(w.encode()) for w in words}))
    return B.Lexicon(str(path)), words


def test_lexicon_holds_its_words_and_no_others(lexicon):
    lex, words = lexicon
    found = lex.find([w.encode() for w in words])
    assert sorted(set(found.tolist())) == list(range(len(set(words))))
    assert all(lex.ids_of(r) == MERGES.merge(w.encode()) for r, w in zip(found, words, strict=True))
    assert lex.find([b"", b" walkin", b" walkingg", b"zzz"]).tolist() == [-1] * 4


def test_suffixes_are_shared():
    few = B.compile_lexicon({w: [1] for w in (b"walking", b"talking")})
    assert struct.unpack_from("<6q", few)[0] == 8


def test_texts_equal_the_library(lexicon):
    for c in (B.Codec(MERGES, None), B.Codec(MERGES, lexicon[0])):
        for t in TEXTS:
            check(c, t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_library(text):
    check(B.Codec(MERGES, None), text)


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in B.op7_bpe_transducer(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert tuple(rows[i]) == (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.encode_texts(empty, PATH, B.build_lexicon(empty, PATH)).count() == 0


def test_most_frequent_words(spark):
    rows = [(f"w{i:03}", 1 + i % 17 * (i % 5)) for i in range(500)]
    counts = spark.createDataFrame(rows, "word string, n long")
    for size in (1, 7, 100, 499, 5000):
        assert B.most_frequent(counts, size) == [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:size]]


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "\n" * 300_000, "x" * 1_000_000, "a." * 500_000, "7" * 1_000_000, "é" * 500_000], ids=range(6))
def test_very_long_words(text):
    check(B.Codec(MERGES, None), text)


def test_long_words_are_neither_counted_nor_kept(spark):
    rng = random.Random(4)
    long = ["".join(rng.choices("abcdefghij", k=100_000)) for _ in range(12)]
    docs = spark.createDataFrame([(i, f"the {w} end") for i, w in enumerate(long)] * 2, "doc_id long, text string")
    assert sorted(r["word"] for r in B.count_words(docs, PATH).collect()) == [" end", "the"]
    codec = B.Codec(MERGES, None)
    for w in long[:3]:
        (ids,) = codec.encode([f"the {w} end {w}"])
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(f"the {w} end {w}", add_special_tokens=False).ids
        assert sorted(codec.met) == [" end", "the"] and codec.size < 1000
    made = B.encode_texts(docs, PATH, B.build_lexicon(docs, PATH)).select("doc_id", "n_tokens", "decoded").collect()
    assert len(made) == 24 and all(r["decoded"] == f"the {long[r['doc_id']]} end" for r in made)


def test_the_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(B, "KEPT_BYTES", 20_000)
    codec, most = B.Codec(MERGES, None), 0
    for i in range(200):
        text = " ".join(f"w{i}x{k}" for k in range(20))
        (ids,) = codec.encode([text])
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(text, add_special_tokens=False).ids
        most = max(most, codec.size)
    assert most < 30_000


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé中7.,-\0\1\n\r\t \u00a0\u2003 \n "), max_size=40), min_size=1, max_size=4))
def test_units_have_the_words_of_their_text(texts):
    units = MERGES.units(texts).to_pylist()
    assert ["".join(us) for us in units] == texts
    assert [[w for u in us for w in MERGES.words.findall(u)] for us in units] == [B.regex.findall(B.PATTERN, t) for t in texts]
    for t, ids in zip(texts, B.Codec(MERGES, None).encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(t, add_special_tokens=False).ids


def test_words_merged_together_equal_words_merged_alone():
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlé .中", k=rng.randrange(30))).encode() for _ in range(8000)] + [bytes([b]) * 2 for b in range(256)]
    assert B.Merges(PATH).merge_all(words) == [struct.pack(f"<{len(i)}I", *i) for i in map(MERGES.merge, words)]
    assert MERGES.merge_all([]) == []


def test_letters_alone_are_one_word():
    every = [w for k in range(0x110000) if not 0xD800 <= k < 0xE000 for w in (chr(k), " " + chr(k))]
    alone = pc.match_substring_regex(pa.array(every), B.ONE_WORD).to_pylist()
    assert sum(alone) > 200_000 and all(MERGES.words.findall(w) == [w] for w, is_one in zip(every, alone, strict=True) if is_one or B.one_word(w))


def test_words_of_units(spark):
    units = pa.table({"word": pa.array([" the", "the,", " a\n", "x" * 65, "it's", "", " the."], pa.large_string()), "n": [5, 2, 3, 4, 1, 9, 7]})
    found = B.words_of(units, MERGES.words.findall)
    assert dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)) == {" the": 12, "the": 2, ",": 2, " a": 3, "\n": 3, "it": 1, "'s": 1, ".": 7}
    texts = ["the cat, the  cat's\n\n hat. " * k + "中文,abc-" * 9 for k in range(30)] + [None, "", "<|endoftext|>the"]
    want = B.Counter(w for t in texts for piece, special in MERGES.pieces(t or "") if special is None for w in MERGES.words.findall(piece))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["word"]: r["n"] for r in B.count_words(docs, PATH).collect()} == want


class Seen:
    """The pattern, counting the characters that go through it."""

    def __init__(self):
        self.characters = 0

    def findall(self, text):
        self.characters += len(text)
        return MERGES.words.findall(text)


def test_only_new_units_go_through_the_pattern():
    merges = B.Merges(PATH)
    merges.words = seen = Seen()
    codec, text = B.Codec(merges, None), "the cat, 7\n\nit's (so)! " * 1000
    for _ in range(2):
        (ids,) = codec.encode([text])
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert 0 < seen.characters < 100


def test_words_of_a_text_without_spaces_are_kept():
    codec, text = B.Codec(MERGES, None), "中文,abc-" * 1000 + "a" * 100
    (ids,) = codec.encode([text])
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert sorted(codec.met) == [",", "-", "abc", "中文"] and codec.size == sum(150 + len(w.encode()) + len(x) for w, x in codec.met.items())
