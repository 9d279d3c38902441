"""Byte-level BPE by a minimal acyclic transducer lexicon with exact merging of unseen words.

All words of the corpus of at most LONGEST characters are counted; the LEXICON most frequent are merged once and compiled into a minimal acyclic automaton whose
equal suffixes are shared. Its arcs carry numbers that add up along a word to the word's rank, which addresses the word's ids: a
transducer from bytes to ids. The compiled arrays are one file in the shared folder, which Spark hands to each executor and each
worker memory-maps. A word outside the lexicon is merged exactly by the tokenizer's merge ranks, so the lexicon's size changes
speed and never ids. Texts are cut into units, mostly a word and the signs after it; only units not met before are split into words.

Defined results: a null text is empty and has no ids; equal texts have equal ids; repeated rows stay; an empty table gives an
empty result; extra columns are ignored. The special tokens of the tokenizer file are found in texts, as its library does by
default. Units of at most LONGEST characters, and the words of longer ones, are kept per worker up to KEPT_BYTES, then forgotten together; texts are handled whole, in blocks of about BATCH characters.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, column, materialize, shared_dir, table

LEXICON = 131_072
KEPT_BYTES, LONGEST = 150_000_000, 64
HELD = 24_000_000  # bytes of counted units in a task
BATCH = 2_000_000  # characters whose words are looked up together
MADE, NEVER = (1 << 32) - 1, 1 << 62
TOGETHER = 24  # bytes of a word up to which words are merged together
# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same words, the commonest kind tried first: what begins with an apostrophe has no letter there.
WORDS = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ONE_WORD = r"^ ?\pL+$"  # as Arrow knows it


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files: itself if it is visible Latin-1, else the next letter from U+0100 on."""
    out, other = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[chr(b)] = b
        else:
            out[chr(other)] = b
            other += 1
    return out


class PairTable:
    """Pairs of ids and their packed merges as a hash table with free places, asked for many pairs at once."""

    def __init__(self, packed: dict[tuple[int, int], int]):
        pairs = np.array(list(packed), np.int64).reshape(-1, 2)
        values = np.array(list(packed.values()), np.int64)
        self.shift = np.uint64(64 - max(10, (8 * len(pairs)).bit_length()))
        self.keys = np.full((1 << (64 - int(self.shift))) + 1, -1, np.int64)
        self.values = np.full(len(self.keys), NEVER, np.int64)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        at, rest = self._first(key), np.arange(len(key))
        while len(rest):  # the first of those that meet takes the place, the others go on
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = key[rest[won]], values[rest[won]]
            rest, at = np.delete(rest, won), np.delete(at, won)
            at = (at + 1) % len(self.keys)

    def _first(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | id of the merge of a and b, or NEVER."""
        key = a << 32 | b
        at = self._first(key)
        met = self.keys[at]
        out = self.values[at]
        other = np.nonzero((met != key) & (met != -1))
        if len(other[0]):
            key, at = key[other], at[other]
            found, rest = np.full(len(key), NEVER, np.int64), np.arange(len(key))
            while len(rest):
                at[rest] = (at[rest] + 1) % len(self.keys)
                met = self.keys[at[rest]]
                found[rest] = np.where(met == key[rest], self.values[at[rest]], NEVER)
                rest = rest[(met != key[rest]) & (met != -1)]
            out[other] = found
        return out


class Merges:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [0] * 256
        for i, b in self.bytes.items():
            if len(b) == 1:
                self.of_byte[b[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.packed = {p: rank << 32 | made for p, (rank, made) in self.ranks.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.white = [c for k in range(0, 0x110000, 4096) for c in regex.findall(r"\s", "".join(map(chr, range(k, k + 4096))))]
        self.pieces_of_id = pa.array([self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)], pa.large_binary())
        self.table = PairTable(self.packed)

    def units(self, texts: list[str]) -> pa.ListArray:
        """Each text in units whose words are those that each has alone, so that only distinct units need the pattern.

        They are cut before spaces and line ends that follow another character than white space: no word goes on over such a place,
        and the pattern looks ahead for white space only from white space. The cuts are marked by characters that no text holds in this order."""
        mark = "\0\1"
        while any(mark in t for t in texts):
            mark += "\1"
        inside = [(w + mark, w) for w in self.white]
        cut = []
        for t in texts:
            t = t.replace(" ", mark + " ").replace("\n", mark + "\n")
            for marked, w in inside:
                if marked in t:
                    t = t.replace(marked, w)
            cut.append(t)
        return pc.split_pattern(pa.array(cut, pa.large_string()), mark)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """As merge, as little-endian unsigned 32-bit integers: words of one length take their merges together, each word its next one in each step."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        of_byte = np.array(self.of_byte, np.int64)
        for n, ks in by_length.items():
            if n < 2 or n > TOGETHER or len(ks) < 32:
                for k in ks:
                    out[k] = np.array(self.merge(words[k]), "<u4").tobytes()
                continue
            own = np.array(ks)
            ids = of_byte[np.frombuffer(b"".join([words[k] for k in ks]), np.uint8).reshape(-1, n).T]
            ranks = self.table.get(ids[:-1], ids[1:])
            while len(own):
                at = ranks.argmin(0)
                best = ranks[at, np.arange(len(own))]
                if (over := best == NEVER).any():
                    done = np.ascontiguousarray(ids[:, over].T, "<u4").tobytes()
                    width = 4 * len(ids)
                    for i, k in enumerate(own[over].tolist()):
                        out[k] = done[i * width : (i + 1) * width]
                    own, ids, ranks, at, best = own[~over], ids[:, ~over], ranks[:, ~over], at[~over], best[~over]
                    if not len(own):
                        break
                col, left = np.arange(len(own)), len(ids) - 1
                ids = np.where(np.arange(left)[:, None] <= at, ids[:-1], ids[1:])
                ids[at, col] = made = best & MADE
                ranks = np.where(np.arange(left - 1)[:, None] < at, ranks[:-1], ranks[1:])
                if left > 1:
                    c = np.flatnonzero(at > 0)
                    ranks[at[c] - 1, c] = self.table.get(ids[at[c] - 1, c], made[c])
                    c = np.flatnonzero(at < left - 1)
                    ranks[at[c], c] = self.table.get(made[c], ids[at[c] + 1, c])
                else:
                    ranks = np.full((1, len(own)), NEVER)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact: always the pair of lowest rank, the leftmost among equals."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, never = self.packed.get, NEVER
        ranks = [get(p, never) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i : i + 2] = [best & MADE]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.ranks[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = made, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
                if (p := (made, ids[right[j]])) in self.ranks:
                    heapq.heappush(heap, (*self.ranks[p], i, *p))
            if left[i] >= 0 and (p := (ids[left[i]], made)) in self.ranks:
                heapq.heappush(heap, (*self.ranks[p], left[i], *p))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of plain text (None) and special tokens (their ids)."""
        for s in self.split.split(text) if self.split else [text]:
            if s:
                yield s, self.special.get(s)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words and their ids, as one block of arrays.

    Words are added in byte order; as soon as a state can change no more it is replaced by an equal one seen before (same arcs,
    same end mark), so suffixes are shared. An arc's number is how many words come before it in its state."""
    arcs: list[list[list[int]]] = [[]]  # per state: [byte, target]
    final = [False]
    seen: dict[tuple, int] = {}
    path = [0]

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            s = path.pop()
            key = (final[s], *(x for a in arcs[s] for x in a))
            if (same := seen.setdefault(key, s)) != s:
                arcs[path[-1]][-1][1] = same
                arcs[s] = []

    before = b""
    order = sorted(words)
    for w in order:
        common = len(os.path.commonprefix([before, w]))
        settle(common)
        for b in w[common:]:
            arcs.append([])
            final.append(False)
            arcs[path[-1]].append([b, len(arcs) - 1])
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = w
    settle(0)
    number: dict[int, int] = {}
    new = {0: 0}
    todo = [0]
    for s in todo:  # states that are still in use, numbered from the root
        for _, t in arcs[s]:
            if t not in new:
                new[t] = len(todo)
                todo.append(t)
    stack = [0]
    while stack:  # words below each state
        s = stack[-1]
        if open_ := [t for _, t in arcs[s] if t not in number]:
            stack += open_
        else:
            number[s] = int(final[s]) + sum(number[t] for _, t in arcs[s])
            stack.pop()
    rows = []
    for s in todo:
        plus = int(final[s])
        for b, t in arcs[s]:
            rows.append((new[s] << 8 | b, new[t], plus))
            plus += number[t]
    rows.sort()
    ids = [words[w] for w in order]
    starts = np.zeros(len(order) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=starts[1:])
    columns = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    columns += [np.array([final[s] for s in todo], np.int64), starts, np.array([i for x in ids for i in x], np.int64)]
    return struct.pack("<6q", *map(len, columns)) + b"".join(c.astype("<i8").tobytes() for c in columns)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        whole = np.asarray(np.memmap(path, "<i8", "r"))  # a plain view of the mapped file
        at = 6
        out = []
        for n in whole[:6]:
            out.append(whole[at : at + n])
            at += n
        self.keys, self.targets, self.plus, self.final, self.starts, self.ids = out
        self.block = self.ids.astype("<u4").tobytes()

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, or -1: all words take their steps together."""
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(words):
            return rank
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        going = np.flatnonzero(lengths > 0)
        state[lengths == 0] = -1
        step = 0
        while len(going):
            key = state[going] << 8 | flat[starts[going] + step]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(going), bool)
            state[going] = np.where(hit, self.targets[at] if len(self.keys) else 0, -1)
            rank[going] += np.where(hit, self.plus[at] if len(self.keys) else 0, 0)
            step += 1
            going = going[hit & (lengths[going] > step)]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] > 0
        return np.where(ok, rank, -1)

    def all_ids(self, ranks: np.ndarray) -> list[bytes]:
        """The ids of each rank as little-endian unsigned 32-bit integers; of -1, none."""
        at = np.maximum(ranks, 0)
        last = np.where(ranks < 0, self.starts[at], self.starts[np.minimum(at + 1, len(self.starts) - 1)])
        return [self.block[4 * a : 4 * b] for a, b in zip(self.starts[at].tolist(), last.tolist(), strict=True)]

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tolist()


def one_word(unit: str) -> bool:
    """Whether a unit is a word of letters alone, as most are; what Python calls letters is within the pattern's."""
    return (unit[1:] if unit[:1] == " " else unit).isalpha()


def blocks(values: pa.LargeBinaryArray, at: np.ndarray) -> list[bytes]:
    """Values joined in blocks, which begin and end at places of at."""
    starts = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1][at].tolist()
    data = memoryview(values.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(starts, starts[1:], strict=False)]


class Codec:
    """Texts to ids and back. Holds the units met so far, of at most LONGEST characters each and about KEPT_BYTES in all."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.met: dict[str, bytes] = {}
        self.size = 0

    def _meet(self, units: list[str]) -> None:
        """Keeps the ids of units, and of the words of long ones. Words are looked up, and those outside the lexicon merged, together."""
        met, find = self.met, self.merges.words.findall
        words = {u: find(u) for u in units if not one_word(u)}
        new = [u for u in units if u not in words]
        new += set(chain.from_iterable(words.values())).difference(met, new)
        raw = [w.encode() for w in new]
        ranks = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1)
        ids = self.lexicon.all_ids(ranks) if self.lexicon else [b""] * len(raw)
        other = np.flatnonzero(ranks < 0).tolist()
        for k, x in zip(other, self.merges.merge_all([raw[k] for k in other]), strict=True):
            ids[k] = x
        of = dict(zip(new, ids, strict=True))
        kept = {u: b"".join([of[w] if w in of else met[w] for w in ws]) for u, ws in words.items()}
        kept |= {w: of[w] for u, ws in words.items() if len(u) > LONGEST for w in ws if len(w) <= LONGEST and w in of}
        kept |= {u: of[u] for u in units if u not in words}
        met |= kept
        self.size += 150 * len(kept) + len("".join(kept).encode()) + sum(map(len, kept.values()))

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens. New units of all texts are met together."""
        met = self.met
        if self.size > KEPT_BYTES:
            met.clear()
            self.size = 0
        lists = self.merges.units(texts)
        flat = lists.flatten().dictionary_encode()
        units = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [u for u in units if u not in met]:
            self._meet(new)
        out = blocks(pa.array(list(map(met.__getitem__, units)), pa.large_binary()).take(flat.indices), lists.offsets.to_numpy())
        for u in new:
            if len(u) > LONGEST:
                self.size -= 150 + len(u.encode()) + len(met.pop(u))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [list(self.merges.pieces(t)) for t in texts]
        plain = [piece for t in split for piece, special in t if special is None]
        made = iter(self._encode_plain(plain) if plain else ())
        return [b"".join([struct.pack("<I", special) if special is not None else next(made) for _, special in t]) for t in split]

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """The text of each block of ids: the bytes of all ids are taken together, then cut."""
        taken = self.merges.pieces_of_id.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return [b.decode("utf-8", "replace") for b in blocks(taken, np.cumsum([0, *[len(x) // 4 for x in ids]]))]


def summed(tables: list[pa.Table]) -> pa.Table:
    """word, n: one row a word."""
    made = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": made.column("word"), "n": made.column("n_sum")})


def words_of(units: pa.Table, find) -> pa.Table:
    """The words of at most LONGEST characters in units(word, n). Units of letters alone are words; the others go through the pattern."""
    alone = pc.match_substring_regex(units.column("word"), ONE_WORD)
    counts: Counter = Counter()
    rest = units.filter(pc.invert(alone))
    for u, n in zip(rest.column("word").to_numpy().tolist(), rest.column("n").to_numpy().tolist(), strict=True):
        for w in find(u):
            counts[w] += n
    found = summed([units.filter(alone), pa.table({"word": pa.array(list(counts), pa.large_string()), "n": pa.array(list(counts.values()), pa.int64())})])
    return found.filter(pc.less_equal(pc.utf8_length(found.column("word")), LONGEST))


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """word, n: every word of at most LONGEST characters of every text; longer ones are merged where they stand, so ids do not depend on this. Units are first summed in each task, in tables of at most about HELD bytes, then split into words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, held = merges_of(path), []

        def words() -> Iterator[pa.RecordBatch]:
            found = words_of(summed(held), merges.words.findall) if held else None
            held.clear()
            for b in found.combine_chunks().to_batches(max_chunksize=100_000) if found else ():
                yield pa.record_batch([b.column(0).cast(pa.string()), b.column(1)], names=["word", "n"])

        for b in batches:
            for texts in blocks_of(column(b, "text"), lambda t: len(t or ""), BATCH):
                plain = [piece for t in texts for piece, special in merges.pieces(t or "") if special is None]
                found = merges.units(plain).flatten().value_counts()
                held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                if sum(t.nbytes for t in held) > HELD:
                    held[:] = [summed(held)]
                    if held[0].nbytes > HELD // 2:
                        yield from words()
        yield from words()
        pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def publish(spark: SparkSession, block: bytes) -> str:
    """Writes the block into the shared folder and has Spark bring it to every executor; returns the name it has there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    target = f"{shared_dir(spark).rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    for i in range(0, len(block), 1 << 20):
        out.write(bytearray(block[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(target if "://" in target or target.startswith("file:") else f"file://{target}")
    return name


def most_frequent(counts: DataFrame, size: int) -> list[str]:
    """The size most frequent words of counts(word, n). Counts are put in steps first, at most some hundred rows, so that only words that can be among them are sorted."""
    step = F.floor(F.log2("n") * 8)
    steps = {r["s"]: r["words"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("words")).collect()}
    least, so_far = 0, 0
    for s in sorted(steps, reverse=True):
        least, so_far = s, so_far + steps[s]
        if so_far >= size:
            break
    return counts.filter(step >= least).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow().column(0).to_pylist()


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compiles the size most frequent words and publishes them. Only those come to the driver."""
    merges = Merges(path)
    top = most_frequent(materialize(count_words(docs, path), "words"), size)
    words = {w.encode("utf-8", "surrogatepass"): None for w in top}
    return publish(docs.sparkSession, compile_lexicon({b: merges.merge(b) for b in words}))


@lru_cache(maxsize=1)
def merges_of(path: str) -> Merges:
    """This worker's vocabulary and merges of a tokenizer file."""
    return Merges(path)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, name: str) -> Codec:
    """This worker's codec for a published lexicon."""
    if (path, name) not in _codecs:
        _codecs.clear()
        _codecs[path, name] = Codec(merges_of(path), Lexicon(SparkFiles.get(name)))
    return _codecs[path, name]


def encode_texts(docs: DataFrame, path: str, lexicon: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lexicon)
        for b in batches:
            for rows in blocks_of(zip(column(b, "doc_id"), column(b, "text"), strict=True), lambda r: len(r[1] or ""), BATCH):
                ids = c.encode([t or "" for _, t in rows])
                yield pa.record_batch(
                    [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(c.decode_all(ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path()
    made = encode_texts(docs, path, build_lexicon(docs, path))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
