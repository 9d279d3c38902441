"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

A document's ids are those of the tokenizer file plus END; only a document of over CAPACITY ids is cut, into pieces of CAPACITY
from its end, so that the first piece may be shorter. Full pieces are sequences of their own. All other pieces are dealt by a
hash into blocks of about BLOCK items, each of which is bred on ISLANDS islands: an island is one row that holds the block's item
sizes and a few packings, and evolves by itself. Its founders are best fits of disturbed orders. Crossover injects whole
well-filled bins of one packing into another, dissolves the bins that held the same items, lets displaced items take the places of
smaller ones where that fills a bin, and puts the rest by best fit, largest first; mutation does so with the emptiest bins. Between rounds the best packing of each island moves to the next
island of its block. All generations run unless a packing is the best there can be: as few bins as the sizes allow, all but one
of them full.

Bins with at most SLACK free places are kept; the items of the others go to the next level, in fewer blocks, until they fit into
one block. Where more than nine tenths of a level's items would come back, as happens where sizes do not fit together, the better half of
its bins is kept, so blocks at least halve then. So a task holds one block, of a bounded number of items, whatever the input's size;
a level wastes at most SLACK places a sequence, or what sizes that do not fit together make its better half waste.

Defined results: a null text is empty and is one piece of the id END; repeated rows are packed each; an empty table gives an
empty result; extra columns are ignored; equal sizes are broken by item number, so a run can be repeated. Texts of any length are
encoded whole; long runs of white space are cut out first, where the split pattern cuts too, as its engine keeps a stack of them.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters, tokenizer_path
from .common import column, materialize, parallelism, table

CAPACITY, END = 2048, 0
BLOCK, ISLANDS, ROUNDS, GENERATIONS, POPULATION, SLACK = 8192, 3, 3, 8, 6, 2
LONG = 1000
# Fixed value: the characters that the split pattern takes for white space.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = re.compile(f"{WHITE}{{{LONG},}}")


class Encoder:
    """The tokenizer file as a rank encoder: the same ids, faster. Refuses files whose merge order is not their id order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the merges")
        self.ranks = {bytes(letters[c] for c in t): i for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.whole: tiktoken.Encoding | None = None  # takes a text for one word; made when a long run is met

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of the text, and whether each is a long run of white space. A run's last character belongs to what follows, but before a special token or the end."""
        at = 0
        for m in LONG_RUN.finditer(text):
            end = m.end() if m.end() == len(text) or text.startswith(tuple(self.special), m.end()) else m.end() - 1
            yield text[at : m.start()], False
            yield text[m.start() : end], True
            at = end
        yield text[at:], False

    def ids(self, text: str) -> np.ndarray:
        if not LONG_RUN.search(text):
            return self.split.encode_to_numpy(text, allowed_special="all")
        if self.whole is None:
            self.whole = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=self.ranks, special_tokens={})
        return np.concatenate([self.whole.encode_to_numpy(t) if run else self.split.encode_to_numpy(t, allowed_special="all") for t, run in self._parts(text)])


def cut(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32: the pieces of each document."""
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            out = []
            for doc, text in zip(column(b, "doc_id"), column(b, "text"), strict=True):
                ids = np.append(encoder.ids(text or ""), END).astype("<u4")
                at = 0
                for piece in range(-(-len(ids) // CAPACITY)):
                    to = len(ids) - (-(-len(ids) // CAPACITY) - 1 - piece) * CAPACITY
                    out.append((doc, piece, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at = to
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            values = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, columns)


class Bin(list):
    """Items, with the places that they leave free."""

    __slots__ = ("free",)


def bin_of(items: list[int], sizes: list[int]) -> Bin:
    b = Bin(items)
    b.free = CAPACITY - sum(map(sizes.__getitem__, items))
    return b


class Bins:
    """Bins by their free places; finds the fullest bin that an item fits into. Full bins are only kept, and never changed."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.bins = sizes, []
        self.by_free: list[list[Bin]] = [[] for _ in range(CAPACITY + 1)]
        self.mask = 0

    def keep(self, b: Bin) -> None:
        if b.free:
            new = Bin(b)
            new.free = b.free
            self.by_free[b.free].append(new)
            self.mask |= 1 << b.free
            b = new
        self.bins.append(b)

    def best_fit(self, items: list[int]) -> None:
        sizes, by_free, bins = self.sizes, self.by_free, self.bins
        for i in items:
            n = sizes[i]
            rest = self.mask >> n
            if rest:
                f = n + (rest & -rest).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    self.mask ^= 1 << f
                b.append(i)
            else:
                f = CAPACITY
                b = Bin((i,))
                bins.append(b)
            f -= n
            b.free = f
            if f:
                by_free[f].append(b)
                self.mask |= 1 << f


Packing = list[list[int]]


def largest_first(items: list[int], sizes: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-sizes[i], i))


def exchange(kept: list[Bin], loose: list[int], sizes: list[int]) -> tuple[list[Bin], list[int]]:
    """In bins with free places one item gives way to a larger loose one, so that the bin is as full as one exchange can make it; what is loose then is smaller and fits more easily."""
    order = sorted(loose, key=lambda i: (sizes[i], i))
    keys = [sizes[i] for i in order]
    out = []
    for b in kept:
        free = b.free
        gain, best = 0, None
        for at, i in enumerate(b) if free and keys else ():
            k = bisect_right(keys, sizes[i] + free) - 1
            if k >= 0 and keys[k] - sizes[i] > gain:
                gain, best = keys[k] - sizes[i], (at, k)
        if best:
            at, k = best
            old, new = b[at], order.pop(k)
            keys.pop(k)
            b = Bin([*b[:at], new, *b[at + 1 :]])
            b.free = free - gain
            k = bisect_left(keys, sizes[old])
            order.insert(k, old)
            keys.insert(k, sizes[old])
        out.append(b)
    return out, order


def rebuild(kept: list[Bin], loose: list[int], sizes: list[int]) -> list[Bin]:
    kept, loose = exchange(kept, loose, sizes)
    made = Bins(sizes)
    for b in kept:
        made.keep(b)
    made.best_fit(largest_first(loose, sizes))
    return made.bins


def fitness(packing: Packing, sizes: list[int]) -> tuple[int, float]:
    """Fewer bins first, then fuller ones among as many: sums of squared fills."""
    return -len(packing), sum((CAPACITY - (b.free if type(b) is Bin else bin_of(b, sizes).free)) ** 2 for b in packing)


def crossover(a: list[Bin], b: list[Bin], sizes: list[int], rng: random.Random) -> list[Bin]:
    """Injects a share of b's well-filled bins into a, dissolves a's bins that hold the same items, best-fits what was displaced."""
    full = [x for x in b if x.free <= SLACK] or b
    injected = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
    there = {i for x in injected for i in x}
    kept, loose = list(injected), []
    for x in a:
        if there.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in there]
    return rebuild(kept, loose, sizes)


def mutate(a: list[Bin], sizes: list[int], rng: random.Random) -> list[Bin]:
    """Dissolves the emptiest bins and a few others."""
    order = sorted(range(len(a)), key=lambda k: -a[k].free)
    gone = {*order[: 1 + len(a) // 50], *rng.sample(range(len(a)), 1 + len(a) // 50)}
    return rebuild([x for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]], sizes)


def founders(sizes: list[int], rng: random.Random) -> list[list[Bin]]:
    """Best fits of disturbed falling orders."""
    items = list(range(len(sizes)))
    out = []
    for _ in range(POPULATION):
        made = Bins(sizes)
        made.best_fit(sorted(items, key=lambda i: -sizes[i] * rng.uniform(0.7, 1)))
        out.append(made.bins)
    return out


def perfect(sizes: list[int]) -> tuple[int, float]:
    """A fitness that no packing exceeds: as few bins as the sum allows, all but one of them full."""
    total = sum(sizes)
    return -(-(-total // CAPACITY)), total // CAPACITY * CAPACITY**2 + (total % CAPACITY) ** 2


@dataclass
class Bred:
    """What happened on an island: generations, children of crossovers, those of them that displaced another packing."""

    generations: int = 0
    crossovers: int = 0
    survivors: int = 0


def evolve(sizes: list[int], packings: list[Packing], seed: int) -> tuple[list[Packing], Bred]:
    """GENERATIONS of an island; the best packing comes first and is never lost. Ends early only at a packing that none could exceed."""
    rng, bred, best = random.Random(seed), Bred(), perfect(sizes)
    packings = [[b if type(b) is Bin else bin_of(b, sizes) for b in p] for p in packings]
    ranked = sorted(((fitness(p, sizes), k, p) for k, p in enumerate(packings or founders(sizes, rng))), key=lambda x: x[0], reverse=True)
    for _ in range(GENERATIONS):
        if ranked[0][0] >= best:
            break
        a, b = rng.sample(ranked, 2) if len(ranked) > 1 else ranked * 2
        made = [crossover(a[2], b[2], sizes, rng), mutate(ranked[0][2], sizes, rng)]
        fresh = [(fitness(p, sizes), -1 - k, p) for k, p in enumerate(made)]
        ranked = sorted([*ranked, *fresh], key=lambda x: x[0], reverse=True)[:POPULATION]
        bred.generations += 1
        bred.crossovers += 1
        bred.survivors += any(x is fresh[0] for x in ranked)
    return [p for _, _, p in ranked], bred


BRED = ("generations", "crossovers", "survivors", "migrations")
ISLAND = "block long, island int, items array<long>, sizes array<int>, packings array<array<int>>, " + ", ".join(f"{c} int" for c in BRED)


def to_numbers(packing: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(packing):
        for i in b:
            out[i] = k
    return out


def to_bins(numbers: list[int]) -> Packing:
    out: Packing = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return [b for b in out if b]


def _round(islands: DataFrame, number: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                packings, bred = evolve(row["sizes"], [to_bins(p) for p in row["packings"]], row["block"] * 1009 + row["island"] * 31 + number)
                row["packings"] = [to_numbers(p, len(row["sizes"])) for p in packings]
                for c in BRED[:3]:
                    row[c] += getattr(bred, c)
                yield pa.RecordBatch.from_pylist([row], schema=b.schema)

    return islands.mapInArrow(run, ISLAND)


def _migrate(islands: DataFrame) -> DataFrame:
    """The first packing of each island takes the place of the last of the next island."""
    elite = islands.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.element_at("packings", 1).alias("elite"))
    kept = F.slice("packings", 1, F.greatest(F.lit(1), F.least(F.size("packings"), F.lit(POPULATION - 1))))
    moved = islands.join(elite, ["block", "island"])
    return moved.select("block", "island", "items", "sizes", F.concat(kept, F.array("elite")).alias("packings"), *BRED[:3], (F.col("migrations") + 1).alias("migrations"))


def _bins_of(best: DataFrame) -> DataFrame:
    """Rows of the best packing: item, size, block, bin, offset, free, and the block's BRED."""
    columns = "item long, size int, block long, bin long, offset long, free int, " + ", ".join(f"{c} int" for c in BRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = []
                for k, members in enumerate(to_bins(row["packing"])):
                    at, free = 0, CAPACITY - sum(row["sizes"][i] for i in members)
                    for i in members:
                        out.append((row["items"][i], row["sizes"][i], row["block"], k, at, free, *(row[c] for c in BRED)))
                        at += row["sizes"][i]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * (1 + len(BRED)))
                yield pa.record_batch([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return best.mapInArrow(run, columns)


def pack_level(items: DataFrame, blocks: int, salt: int) -> DataFrame:
    """items(item, size) -> item, size, block, bin, offset, free, BRED. One row of a block's items is at most some thousand numbers."""
    dealt = items.select(F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(blocks)).alias("block"), F.struct("item", "size").alias("x"))
    rows = dealt.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    islands = rows.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.col("x.item").alias("items"),
        F.col("x.size").alias("sizes"),
        F.array().cast("array<array<int>>").alias("packings"),
        *[F.lit(0).alias(c) for c in BRED],
    )
    for number in range(ROUNDS):
        # a given number of partitions, as small rows stand for long work
        ready = _migrate(materialize(islands, "islands")) if number else islands
        islands = _round(ready.repartition(parallelism(items.sparkSession), "block", "island"), number)
    first = F.element_at("packings", 1)
    bred = islands.select("block", "items", "sizes", first.alias("packing"), F.array_max(first).alias("bins"), *BRED)
    best = bred.groupBy("block").agg(F.min_by(F.struct("items", "sizes", "packing"), "bins").alias("b"), *[F.sum(c).cast("int").alias(c) for c in BRED])
    return _bins_of(best.select("block", "b.*", *BRED))


def _kept_up_to(made: DataFrame, n: int) -> int:
    """Free places up to which bins of a level are kept: SLACK, or, where more than nine tenths of its n items would come back, those of the better half."""
    bins = {r["free"]: (r["items"], r["bins"]) for r in made.groupBy("free").agg(F.count("*").alias("items"), F.count_if(F.col("offset") == 0).alias("bins")).collect()}  # at most CAPACITY rows
    back = sum(items for free, (items, _) in bins.items() if free > SLACK)
    if back <= n * 9 // 10:
        return SLACK
    so_far, half = 0, sum(b for _, b in bins.values()) / 2
    for free in sorted(bins):
        so_far += bins[free][1]
        if so_far >= half:
            return max(SLACK, free)
    return CAPACITY


def pack(pieces: DataFrame) -> DataFrame:
    """pieces(item, length) with distinct items -> item, sequence_id, offset, and BRED of the block that placed it (0 for full pieces). Lengths are 1 to CAPACITY."""
    none = [F.lit(0).alias(c) for c in BRED]
    full = pieces.filter(F.col("length") == CAPACITY).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *none)
    left, done = pieces.filter(F.col("length") < CAPACITY).select("item", F.col("length").cast("int").alias("size")), [full]
    n, level = left.count(), 0
    while n:
        blocks = -(-n // BLOCK)
        made = materialize(pack_level(left, blocks, level), "packed")
        slack = _kept_up_to(made, n) if blocks > 1 else CAPACITY
        number = F.shiftleft(F.lit(level).cast("long"), 44) + F.shiftleft(F.col("block"), 16) + F.col("bin")
        done.append(made.filter(F.col("free") <= slack).select("item", number.alias("sequence_id"), "offset", *BRED))
        left, level = made.filter(F.col("free") > slack).select("item", "size"), level + 1
        n = left.count() if slack < CAPACITY else 0
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset, BRED."""
    pieces = materialize(cut(docs, path).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces), "item").drop("item")


def op2_pack_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
