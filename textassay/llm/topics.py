"""Topics of texts: spherical k-means over weighted words, fitted on all texts and applied to whole texts.

Every text counts each of its different words once. The `vocabulary` words met in most texts, in at least `least` and at
most half of them, are used, weighted by inverse document frequency; a text is the unit vector of its words' weights.
Lloyd's sweeps run over all texts, each a pass over their word numbers, until the mean likeness to the own centroid
gains less than `gain` of itself or the sweeps run out. Only their starting points, k texts, are chosen among the
`seeds` texts of the smallest hashes, each the farthest from those chosen. Sums are of whole numbers, so
they don't depend on how rows were dealt. What reaches the driver is the vocabulary, the seeds and k sums.

A text's topic is the centroid nearest to its different words. Defined results: texts without a word of the vocabulary,
blank and null ones among them, have the topic "none"; without a usable word every text has it; equal texts have equal
topics; very long texts are read whole; words of over LONG bytes go by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import stage, unstage

NONE = "none"
LONG = 64
#: A task's counts go on once it holds so many different words.
FLUSH = 1 << 17
#: Word numbers taken at a time, and the unit in which vectors are summed.
CHUNK, UNIT = 1 << 18, float(1 << 20)


def _short(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"\0" + hashlib.sha256(word).digest()


class Vocabulary:
    """Words, their numbers and their weights."""

    def __init__(self, words: list[bytes], idf: np.ndarray):
        self.at, self.known, self.idf = {w: i for i, w in enumerate(words)}, frozenset(words), idf

    def numbers(self, words: list[bytes]) -> bytes:
        """The sorted numbers of a text's different words, two bytes each."""
        if words and max(map(len, words)) > LONG:
            words = [*map(_short, words)]
        return np.array(sorted(map(self.at.__getitem__, self.known.intersection(words))), dtype="<u2").tobytes()


class Topics:
    """The fitted centroids: a weight of every word of the vocabulary for each."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights

    def of(self, rows: list[bytes]) -> list[str]:
        """The topics of texts, given as the numbers of their words."""
        out = [NONE] * len(rows)
        for at, _, _, scores in _scored(rows, self.weights):
            for i, best in zip(at, scores.round(9).argmax(axis=1)):
                out[i] = f"topic{best}"
        return out


def _scored(rows: list[bytes], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks: places of the rows that have words, their words' numbers, where each row's start, and its sums of weights."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 2
    some = np.flatnonzero(sizes) if len(weights) else np.empty(0, np.int64)
    ends = np.cumsum(sizes[some])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
        at = some[lo:hi]
        words = np.frombuffer(b"".join([rows[i] for i in at]), dtype="<u2")
        starts = np.cumsum(sizes[at]) - sizes[at]
        yield at, words, starts, np.stack([np.add.reduceat(w[words], starts) for w in weights.T], axis=1)
        lo = hi


def with_numbers(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows with n_tokens and the words' numbers in place of their last column, the text's UTF-8 bytes."""
    keep = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for x in batch.column(len(keep)):
                words = x.as_buffer().to_pybytes().lower().split()
                found.append(vocabulary.numbers(words))
                sizes.append(max(1, len(words)))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(sizes, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in keep] + ["n_tokens", "numbers"])

    return rows.mapInArrow(run, StructType([*keep, StructField("n_tokens", LongType()), StructField("numbers", BinaryType())]))


def _counts(texts: DataFrame) -> DataFrame:
    """(word, n): in how many rows of texts(text, as bytes) each word is met; the null word is met in every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        rows = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*map(_short, held), None], pa.binary()), pa.array([*held.values(), rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for x in batch.column(0):
                held.update({*x.as_buffer().to_pybytes().lower().split()})
                rows += 1
                if len(held) >= FLUSH:
                    yield told()
                    held, rows = Counter(), 0
        yield told()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_vocabulary(texts: DataFrame, least: int = 5, vocabulary: int = 8192) -> Vocabulary:
    """The words of all rows of texts(text, as bytes) that topics are told by."""
    if vocabulary > 1 << 16:
        raise ValueError("a vocabulary has 65536 words at most")
    counts = stage(_counts(texts).filter((F.col("n") >= least) | F.col("word").isNull()), "topic-counts")
    total = counts.filter("word is null").agg(F.sum("n")).head()[0] or 0
    told = counts.filter(F.col("word").isNotNull() & (F.col("n") >= least) & (F.col("n") <= max(least, total // 2)))
    told = told.withColumn("band", F.floor(F.log2("n") * 16))  # so that a task offers words of the last band needed and above alone
    bands, held, low = sorted(told.groupBy("band").count().collect(), reverse=True), 0, 0  # 1024 at most
    for r in bands:
        held, low = held + r["count"], r.band
        if held >= vocabulary:
            break
    found = told.filter(F.col("band") >= low).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    unstage(counts)
    return Vocabulary([bytes(r.word) for r in found], np.log(max(total, 1) / np.array([r.n for r in found], dtype=float)) if found else np.zeros(0))


def _seeds(rows: DataFrame, idf: np.ndarray, k: int, seeds: int) -> np.ndarray:
    """k different starting points (or as many as there are), a row of unit length each."""
    told = rows.filter(F.length("numbers") > 0).select("numbers", F.xxhash64("numbers").alias("h"))
    last = told.select("h").distinct().orderBy("h").limit(seeds).agg(F.max("h")).head()[0]
    if last is None:
        return np.zeros((0, len(idf)))
    drawn = sorted((r.h, bytes(r.numbers)) for r in told.filter(F.col("h") <= last).dropDuplicates(["h"]).collect())  # seeds rows at most
    x = np.zeros((len(drawn), len(idf)))
    for i, (_, numbers) in enumerate(drawn):
        own = np.frombuffer(numbers, dtype="<u2")
        x[i, own] = idf[own]
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[:1]
    while len(centre) < min(k, len(x)):  # each next one is the row farthest from those chosen
        centre = np.vstack([centre, x[np.argmin((x @ centre.T).max(axis=1).round(9))]])
    return centre


def _sweep(rows: DataFrame, idf: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, int]:
    """The sums of the vectors nearest to each centroid, over all rows(numbers), and all their likenesses to it."""
    k, width = centre.shape
    weights = (centre * idf).T

    def tell(sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["centre", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            for _, words, starts, scores in _scored(batch.column(0).to_pylist(), weights):
                sizes = np.diff(np.append(starts, len(words)))
                length = np.sqrt(np.add.reduceat(idf[words] ** 2, starts))
                scale = np.divide(UNIT, length, out=np.zeros_like(length), where=length > 0)
                own = scores.round(9).argmax(axis=1)
                values = np.rint(idf[words] * np.repeat(scale, sizes))
                total[:, :width] += np.bincount(np.repeat(own, sizes) * width + words, weights=values, minlength=k * width).astype(np.int64).reshape(k, width)
                total[:, width] += np.bincount(own, weights=np.rint(scores[np.arange(len(own)), own] * scale), minlength=k).astype(np.int64)
        yield tell(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[c] = held.get(c, 0) + np.frombuffer(sums, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([s.tobytes() for s in held.values()], pa.binary())], ["centre", "sums"])

    parts = rows.select("numbers").mapInArrow(add, "centre int, sums binary")  # k rows of each task
    found = parts.repartition(k, "centre").mapInArrow(merge, "centre int, sums binary").collect()
    total = np.zeros((k, width + 1), dtype=np.int64)
    for r in found:
        total[r.centre] += np.frombuffer(r.sums, dtype=np.int64)
    return total[:, :width], int(total[:, width].sum())


def fit_topics(rows: DataFrame, vocabulary: Vocabulary, k: int = 8, rounds: int = 20, gain: float = 1e-3, seeds: int = 256) -> Topics:
    """Topics fitted on every row of rows(numbers), which is read once a sweep and so should be staged."""
    idf = vocabulary.idf
    centre = _seeds(rows, idf, k, seeds) if len(idf) else np.zeros((0, 0))
    if not len(centre):
        return Topics(vocabulary, np.zeros((0, 0)))
    before = 0
    for _ in range(rounds):
        sums, likeness = _sweep(rows, idf, centre)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(length > 0, sums / np.where(length > 0, length, 1), centre)
        if likeness - before <= gain * likeness:
            break
        before = likeness
    return Topics(vocabulary, (centre * idf).T)
