"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; packing needs their lengths only. Pieces are dealt into shards of bounded size. Each
shard is a bin-packing problem solved by islands: an island holds a few packings, a crossover injects whole
well-filled sequences of one parent into another, drops the sequences that would repeat a piece and best-fits the
displaced pieces again, a mutation dissolves poorly filled sequences, and between epochs every island sends its elite
to the next. An island stops early when it reaches the lower bound. Sequences that the best packing of a shard leaves
under-filled are dissolved, and their pieces are dealt into fewer shards and packed again, until one shard is left or
sizes leave room in every sequence (then each shard's emptiest sequence only), so the loss is that of one shard and
not of each.

Everything between epochs is staged: a lost executor repeats its islands' epoch from the same seeds and gets the same
packings.

Where best fit, the first founder, reaches the lower bound of a shard, as it does on most corpora of many sizes, no
generation is run: no packing can be better. Crossover and mutation work on the other shards.

Defined results: a null or empty text is the end token alone; rows repeating an id are packed separately; equal sizes are
placed in order of their rows; texts of more than a sequence, however long, are cut; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import gc
import os
import random
import re
import struct
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage, unstage

CAPACITY = 4096
END = (1).to_bytes(4, "little")
SHARD = 4096
ISLANDS = 16  # of one task
#: Words, and as many parts of words, whose tokens a Python worker keeps; some 160 bytes each.
MOST_WORDS = 700_000
_TOKENIZERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


LETTERS = _byte_letters()


def _class(kind: str, first: int = 0x21, last: int = 0x24F) -> str:
    """The characters of a Unicode category between two code points, as the inside of a regex class."""
    return "".join(re.escape(chr(c)) for c in range(first, last + 1) if unicodedata.category(chr(c))[0] == kind)


SPACE = "\\x09-\\x0d\\x20"
#: Texts of these characters alone have one normal form, their lower case, in every Unicode version.
PLAIN = re.compile(f"[{SPACE}\x21-\x7e\u00a1-\u012f\u0131-\u024f]*")
#: The tokenizer's own split, for such texts.
PRETOKEN = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{_class('L')}{_class('N')}]+")


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """Values by key, computed when missed; beyond `most` keys the older half goes, and comes back when asked for."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.half, self.old = compute, max(1, most // 2), {}

    def __missing__(self, key):
        if (found := self.old.get(key)) is None:
            found = self.compute(key)
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class WordTokens:
    """Token ids of texts, as little-endian 32-bit bytes and the end token. Parts of this tokenizer never cross ASCII
    white space, so each different word between it is tokenized once. Words of a plain text are split as the tokenizer
    splits them, and each different part goes to its model once; words of other texts go through the whole tokenizer.
    Both give the tokenizer's ids. Up to `most` words and parts are kept."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        self.parts, self.plain, self.words = _Kept(self._part, most), _Kept(self._plain, most), _Kept(self._word, most)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join(map(LETTERS.__getitem__, part.encode()))
        return _little([t.id for t in self.split(letters)])

    def _plain(self, word: str) -> bytes:
        return self.parts[word] if word.isalpha() else b"".join(map(self.parts.__getitem__, PRETOKEN.findall(word)))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text.lower())
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        plain, word = self.plain.__getitem__, self.words.__getitem__
        collects = gc.isenabled()
        gc.disable()  # each full collection would walk the words kept; nothing here makes cycles
        try:
            for data in texts:
                text = data.decode()
                if "<|" not in text and PLAIN.fullmatch(text):
                    yield b"".join(map(plain, text.lower().split())) + END
                else:
                    yield b"".join(map(word, data.split())) + END
                for kept in (self.parts, self.plain, self.words):
                    kept.trim()
        finally:
            if collects:
                gc.enable()


def _tokens(path: str, most: int) -> WordTokens:
    if (path, most) not in _TOKENIZERS:
        _TOKENIZERS[path, most] = WordTokens(path, most)
    return _TOKENIZERS[path, most]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, block_bytes: int = 1 << 20, most_words: int = MOST_WORDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, rid) for every piece; rid tells pieces apart."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path, most_words)
        for batch in batches:
            ids, rows, block, size, took = batch.column(0), [], [], 0, 0
            texts = batch.column(1)

            def flush(block: list[bytes], at: int) -> None:
                for k, data in enumerate(tokens(block)):
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        stop = min(start + capacity, n)
                        rows.append((at + k, piece, start, stop - start, crc32(data[4 * start : 4 * stop])))

            for x in texts:
                text = x.as_buffer().to_pybytes()
                block.append(text)
                size += len(text)
                if size > block_bytes:
                    flush(block, took)
                    took, block, size = took + len(block), [], 0
            flush(block, took)
            at, *rest = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int32()), *(pa.array(c, pa.int64()) for c in rest[1:])], names)

    names = ["id", "piece", "start", "length", "ids_crc32"]
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return stage(found.withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")


Bins = list[list[int]]


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: Bins, room: list[int]) -> None:
    """Put items, in order, each where it leaves the least room, or in a new bin; bins and their room are changed."""
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for i in order:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, k = free.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
            room.append(0)
        room[k] = left = left - size
        if left:
            insort(free, (left, k))


class Island:
    """A population of packings of one shard."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.random = sizes, capacity, random.Random(seed)
        self.bound = -(-sum(sizes) // capacity)

    def packed(self, order: list[int]) -> Bins:
        bins: Bins = []
        best_fit(order, self.sizes, self.capacity, bins, [])
        return bins

    def fill(self, items: list[int]) -> int:
        return sum(map(self.sizes.__getitem__, items))

    def worth(self, bins: Bins) -> tuple:
        """Fewer bins first, then bins more unevenly filled."""
        return (-len(bins), sum(self.fill(b) ** 2 for b in bins))

    def founders(self, n: int) -> list[Bins]:
        falling = sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i])
        found = [self.packed(falling)]
        while len(found) < n and len(found[0]) > self.bound:
            found.append(self.packed(sorted(falling, key=lambda i: -self.sizes[i] * self.random.uniform(0.8, 1.0))))
        return found

    def refit(self, bins: Bins, displaced: list[int]) -> Bins:
        room = [self.capacity - self.fill(b) for b in bins]
        best_fit(sorted(displaced, key=lambda i: -self.sizes[i]), self.sizes, self.capacity, bins, room)
        return bins

    def cross(self, one: Bins, other: Bins) -> Bins:
        filled = sorted(one, key=self.fill, reverse=True)
        injected = [list(b) for b in filled[: max(1, len(filled) // 2)] if self.random.random() < 0.7]
        taken = set(chain.from_iterable(injected))
        kept, displaced = injected, []
        for b in other:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        return self.refit(kept, displaced)

    def mutate(self, bins: Bins) -> Bins:
        ranked = sorted(bins, key=self.fill)
        poor = {id(b) for b in ranked[: max(2, len(bins) // 20)]} | {id(b) for b in self.random.sample(bins, max(1, len(bins) // 20))}
        kept = [list(b) for b in bins if id(b) not in poor]
        displaced = list(chain.from_iterable(b for b in bins if id(b) in poor))
        self.random.shuffle(displaced)
        return self.refit(kept, displaced)

    def evolve(self, population: list[Bins], generations: int, most: int) -> list[Bins]:
        population = sorted(population, key=self.worth, reverse=True)
        for _ in range(generations):
            if len(population[0]) <= self.bound:
                break
            one, other = self.random.sample(population, 2) if len(population) > 1 else (population[0], self.packed(self.random.sample(range(len(self.sizes)), len(self.sizes))))
            child = self.cross(one, other)
            if self.random.random() < 0.5:
                child = self.mutate(child)
            population = sorted([*population, child], key=self.worth, reverse=True)[:most]
        return population


def _genes(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for k, items in enumerate(bins):
        out[items] = k
    return out


def _bins(genes: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(max(genes, default=-1)) + 1)]
    for i, k in enumerate(genes):
        out[k].append(i)
    return out


def _epoch(capacity: int, generations: int, most: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for shard, island, sizes, elites in zip(frame["shard"], frame["island"], frame["sizes"], frame["elites"]):
                world = Island(list(map(int, sizes)), capacity, hash((seed, int(shard), int(island))))
                population = [_bins(e) for e in elites] if elites is not None else world.founders(most)
                population = world.evolve(population, generations, most)
                out.append([_genes(b, len(sizes)) for b in population[:2]] if len(sizes) else [])
            yield frame.assign(elites=out, bins=[int(max(e[0], default=-1)) + 1 if len(e) else 0 for e in out])[["shard", "island", "rids", "sizes", "elites", "bins"]]

    return run


STATE = "shard bigint, island int, rids array<bigint>, sizes array<bigint>, elites array<array<int>>, bins int"


def _pack_level(items: DataFrame, n: int, capacity: int, islands: int, epochs: int, generations: int, most: int, seed: int) -> DataFrame:
    """(shard, rids, sizes, genes): the best packing found of each shard of items(rid, length)."""
    shards = max(1, -(-n // SHARD))
    rows = items.groupBy(F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("rid", "length"))).alias("x"))
    state = rows.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("x.rid").alias("rids"),
        F.col("x.length").alias("sizes"),
        F.lit(None).cast("array<array<int>>").alias("elites"),
    )
    best = []
    for epoch in range(epochs):
        if epoch:
            to = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elites", 1, 1).alias("guest"))
            state = state.join(to, ["shard", "island"]).withColumn("elites", F.concat("elites", "guest")).drop("guest", "bins")
        dealt = state.repartition(-(-shards * islands // ISLANDS), "shard", "island").select("shard", "island", "rids", "sizes", "elites")
        before, state = state, stage(dealt.mapInPandas(_epoch(capacity, generations, most, seed + epoch), STATE), "pack-epoch")
        unstage(before)
        bound = F.ceil(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) / capacity)
        ended = state.groupBy("shard").agg(F.min("bins").alias("bins"), F.first(bound).alias("bound"))
        ended = stage(ended.select("shard", (F.lit(epoch + 1 == epochs) | (F.col("bins") <= F.col("bound"))).alias("ended")), "pack-ended")
        found = state.join(ended.filter("ended"), "shard").groupBy("shard").agg(F.min_by(F.struct("rids", F.element_at("elites", 1).alias("genes"), "sizes"), F.struct("bins", "island")).alias("x"))
        best.append(stage(found.select("shard", "x.rids", "x.sizes", "x.genes"), "pack-best"))
        state = state.join(ended.filter("not ended"), "shard", "left_semi")  # shards at their lower bound are done
        if ended.filter("not ended").isEmpty():
            break
    return reduce(DataFrame.unionAll, best)


def pack(items: DataFrame, capacity: int = CAPACITY, islands: int = 2, epochs: int = 3, generations: int = 8, most: int = 5, seed: int = 1, full: float = 0.985) -> DataFrame:
    """(rid, sequence_id, offset) for every row of items(rid, length); lengths from 1 to capacity.

    While there is more than one shard (`SHARD` items each), pieces of sequences under `full` of the capacity are packed
    again across shards; where these are over nine tenths of the level's pieces (sizes that leave room in every
    sequence), only each shard's emptiest sequence is. Either way a level is smaller than the one before.
    """
    done, level, n = [], 0, items.count()
    while True:
        best = _pack_level(items, n, capacity, islands, epochs, generations, most, seed + 100 * level)
        placed = best.select("shard", F.explode(F.arrays_zip("rids", "sizes", "genes")).alias("x")).select(
            "shard", F.col("x.rids").alias("rid"), F.col("x.sizes").alias("length"), F.col("x.genes").alias("bin")
        )
        staged = stage(placed.withColumn("fill", F.sum("length").over(_bin())), "pack-placed")
        sequence = F.lit(level).cast("long") * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 13) + F.col("bin")
        loose = F.col("fill") < full * capacity
        left = staged.filter(loose).count() if n > SHARD else 0
        if left > 0.9 * n:
            emptiest = staged.groupBy("shard").agg(F.min_by("bin", F.struct("fill", "bin")).alias("emptiest"))
            before, staged = staged, stage(staged.join(emptiest, "shard"), "pack-emptiest")
            unstage(before)
            loose = F.col("bin") == F.col("emptiest")
            left = staged.filter(loose).count()
        kept = staged.filter(~loose) if left else staged
        done.append(kept.select("rid", sequence.alias("sequence_id"), (F.sum("length").over(_bin().orderBy("rid")) - F.col("length")).alias("offset")))
        if not left:
            return stage(reduce(DataFrame.unionAll, done), "pack-sequences")
        items, n, level = stage(staged.filter(loose).select("rid", "length"), "pack-loose"), left, level + 1


def _bin() -> Window:
    return Window.partitionBy("shard", "bin")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset. Fewer `most_words` kept
    take less of a worker's memory and more time, and give the same rows."""
    each = pieces(docs, id_col, text_col, capacity, tokenizer, most_words=most_words)
    places = pack(each.select("rid", "length"), capacity)
    return each.join(places, "rid").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))
