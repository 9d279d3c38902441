"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits: all distinct splits of up to seven languages, else a random code of the greatest
least distance found. For each bit a binary classifier tells the languages with that bit from the others: log odds of hashed
byte n-grams (ORDERS), each language's n-gram distribution counting alike. Decoding adds, for each codeword, the logistic loss of
every bit's margin, weighted by how well that bit's classifier separates its two sides in the learning counts; the nearest
codeword wins, and `ambiguous` flags a posterior of less than SURE.

Learning counts the n-grams of all labelled documents that are not held out. Tasks count in tables of at most TABLES languages, and
the driver takes up to SLOTS counts (128 KB) of each language, so some thousand languages fit; a column of another kind than a
language's, with values without end, is not for this. A prediction sees the text alone. Texts are handled whole.

Defined results: a null text, or one without a letter, is `und` with score 0; with no labelled text at all everything is `und`;
with one language every text with a letter is of it, score 1; equal distances go to the language that sorts first; a null doc_id
counts as held out; repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, column, table

ORDERS, SLOTS, SURE, BLOCK, TABLES = (2, 3), 16_384, 0.5, 200_000, 256
LETTER = regex.compile(r"\p{L}")


def _folding() -> np.ndarray:
    """Bytes as features see them: a-z and bytes of other scripts; A-Z as a-z; all else a space."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = t[65:91] = np.arange(97, 123)
    return t


FOLD = _folding()


def grams(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """In blocks of texts: their numbers, the slots of all n-grams, and where each text's slots begin. A text is framed by spaces, so each has n-grams."""
    raw = [(i, b"  " + t.encode("utf-8", "surrogatepass") + b" ") for i, t in enumerate(texts)]
    for block in blocks_of(raw, lambda x: len(x[1]), BLOCK):
        data = FOLD[np.frombuffer(b"".join(b for _, b in block), np.uint8)].astype(np.uint32)
        ends = np.cumsum([len(b) for _, b in block])
        pair = data[:-1] << 8 | data[1:]
        last = np.zeros(len(data), bool)
        last[ends - 1] = last[ends - 2] = True
        keep = np.flatnonzero(~last)
        two, three = pair[keep], pair[keep] << 8 | data[keep + 2]
        slots = np.stack([(x * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(32 - 14) for k, x in zip(ORDERS, (two, three), strict=True)], 1).ravel()
        starts = np.concatenate([[0], ends[:-1]]) - 2 * np.arange(len(block))
        yield [i for i, _ in block], slots.astype(np.int64), starts * len(ORDERS)


def count_grams(docs: DataFrame) -> DataFrame:
    """docs(text, lang) -> lang, slot, n. Summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                k = np.flatnonzero(c)
                yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(c[k], pa.int64())], names=["lang", "slot", "n"])
            counts.clear()

        for b in batches:
            langs = column(b, "lang")
            for numbers, slots, starts in grams([t or "" for t in column(b, "text")]):
                ends = [*starts[1:], len(slots)]
                by_lang: dict[str, list[np.ndarray]] = {}
                for k, i in enumerate(numbers):
                    by_lang.setdefault(langs[i], []).append(slots[starts[k] : ends[k]])
                for lang, parts in by_lang.items():
                    found = np.bincount(np.concatenate(parts), minlength=SLOTS)
                    counts[lang] = counts.get(lang, 0) + found
                if len(counts) > TABLES:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """n x bits of +1 and -1; no bit is the same for all, no two bits are the same split."""
    if n <= 7:
        splits = range(1, 1 << (n - 1)) if n > 1 else []
        return np.array([[1 if i == 0 or not (s >> (i - 1) & 1) else -1 for s in splits] for i in range(n)], np.int64).reshape(n, max(0, (1 << n >> 1) - 1))
    rng, best, least = np.random.default_rng(n), None, -1
    for _ in range(200):
        code = np.where(rng.random((n, max(15, int(np.ceil(10 * np.log2(n)))))) < 0.5, 1, -1)
        code = code[:, np.abs(code.sum(0)) < n]
        apart = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(n - 1))
        if apart > least:
            best, least = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # SLOTS x bits: log odds
    trust: np.ndarray  # of each bit

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not self.languages:
            return out
        for numbers, slots, starts in grams([texts[i] for i in known]):
            n = np.diff(np.append(starts, len(slots)))[:, None]
            margins = np.add.reduceat(self.weights[slots], starts, axis=0, dtype=np.float64) / np.sqrt(n)
            loss = np.logaddexp(0, -self.code[None] * margins[:, None])
            distance = (loss * self.trust).sum(2)
            near = np.exp(distance.min(1, keepdims=True) - distance)
            score = near / near.sum(1, keepdims=True)
            for k, best in enumerate(distance.argmin(1)):
                out[known[numbers[k]]] = (self.languages[best], float(score[k, best]), bool(score[k, best] < SURE))
        return out


def fit(counts: list[tuple[str, int, int]]) -> Model:
    languages = sorted({lang for lang, _, _ in counts})
    code = codewords(len(languages))
    table_ = np.full((len(languages), SLOTS), 0.5)
    place = {lang: i for i, lang in enumerate(languages)}
    for lang, slot, n in counts:
        table_[place[lang], slot] += n
    share = table_ / table_.sum(1, keepdims=True)
    weights = np.zeros((SLOTS, code.shape[1]), np.float32)
    trust = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        odds = np.log(yes / no)
        weights[:, b] = odds
        trust[b] = ((yes - no) * odds).sum()
    return Model(languages, code, weights, trust / trust.mean() if len(trust) else trust)


def learn(docs: DataFrame) -> Model:
    """docs(text, lang): the labelled documents to learn from."""
    found = count_grams(docs.filter("lang IS NOT NULL AND text IS NOT NULL")).toArrow()
    return fit(list(zip(*(found.column(c).to_pylist() for c in ("lang", "slot", "n")), strict=True)))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns of docs with lang_pred, score and ambiguous; docs must have text, which is the only input of a prediction."""
    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double", "ambiguous boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = model.predict(column(b, "text"))
            kept = [b.column(b.schema.get_field_index(k)) for k in keep]
            new = [pa.array([s[j] for s in said], kind) for j, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([*kept, *new], names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
