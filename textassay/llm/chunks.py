"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes is read at every byte; a chunk ends where its top bits are zero. Chunking is
normalised: below the normal size more bits must be zero, above it fewer, so sizes gather around the normal one, with
a least size (not under the hash's window, so no chunk depends on what stands before it) and a largest one. An
insertion or deletion moves the boundaries near it and no others. The fingerprint is the set of chunk digests with
their lengths; the containment of one text in another is the length of its chunks that the other has too, over the
length of all its chunks.

The edited text of a document needs its successor by id. Documents are dealt into id ranges at approximate quantiles,
each range also gets the first document of the next, and one sorted pass over a range sees every document beside its
successor; no task holds more than a range and no global sort runs in one task.

Defined results: ids must be whole numbers, others are refused; a null text is an empty text; an empty fingerprint is contained only in an empty one (1.0 then, else
0.0); null ids come before all others; rows repeating an id follow each other by text; a sole row is its own
successor; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, shuffle_width

WINDOW, NORMAL, LARGEST = 16, 32, 255
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xE0000000)


def _gear(seed: int = 0) -> np.ndarray:
    """256 pseudo-random words by the SplitMix64 rule."""
    x, out, mask = seed, [], (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append((z ^ (z >> 31)) >> 32)
    return np.array(out, dtype=np.uint32)


GEAR = _gear()


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) where a chunk may end: those that the loose rule allows, and whether the strict one does too."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] += h[:-step] << np.uint32(step)
    at = np.flatnonzero((h & LOOSE) == 0)
    return at + 1, (h[at] & STRICT) == 0


def _cut(n: int, loose: list[int], strict: list[int], start: int = 0) -> list[int]:
    """Ends of the chunks of a text of n bytes from start on."""
    out = []
    while n - start > WINDOW:
        normal, most = start + NORMAL, min(start + LARGEST, n)
        i = bisect_left(strict, start + WINDOW)
        if i < len(strict) and strict[i] < normal:
            start = strict[i]
        else:
            i = bisect_left(loose, normal)
            start = loose[i] if i < len(loose) and loose[i] < most else most
        out.append(start)
    if start < n:
        out.append(n)
    return out


class Chunked:
    """A text's chunk ends and its set of (digest, length)."""

    __slots__ = ("data", "ends", "parts")

    def __init__(self, data: bytes, ends: list[int], kept: list[int] | None = None, parts: list[tuple[int, int]] | None = None):
        kept, parts = kept or [], list(parts or [])
        self.data, self.ends = data, kept + ends
        start = kept[-1] if kept else 0
        for end in ends:
            parts.append((xxh64_intdigest(data[start:end]) >> 16, end - start))
            start = end
        self.parts = parts

    def fingerprint(self) -> str:
        """Each different chunk, sorted: 12 hex digits of its digest and 2 of its length."""
        return "".join([f"{d:012x}{n:02x}" for d, n in sorted(set(self.parts))])


def containment(a: Chunked, b: Chunked) -> float:
    own, other = set(a.parts), set(b.parts)
    if not own:
        return float(not other)
    return sum(n for _, n in own & other) / sum(n for _, n in own)


def chunk_all(texts: list[bytes]) -> list[Chunked]:
    """Chunks of many texts, hashed in one pass over their bytes."""
    out = []
    ends, strict = _marks(b"".join(texts))
    base = 0
    edges = np.cumsum([0, *map(len, texts)])
    lo = np.searchsorted(ends, edges, side="right")
    for k, t in enumerate(texts):
        own, tight = ends[lo[k] : lo[k + 1]] - base, strict[lo[k] : lo[k + 1]]
        out.append(Chunked(t, _cut(len(t), own.tolist(), own[tight].tolist())))
        base += len(t)
    return out


def _edited(pairs: list[tuple[Chunked, str, str]]) -> list[tuple[bytes, Chunked]]:
    """Edited texts, and their chunks: those that end before the edit are the document's own."""
    made, tails = [], []
    for own, text, following in pairs:
        n = len(text) // 4
        keep = text[: len(text) - n].encode()
        data = keep + following[:n].encode()
        ends = own.ends[:-1] if own.ends else []
        kept = ends[: bisect_left(ends, len(keep) + 1)]
        made.append((data, kept, own.parts[: len(kept)]))
        tails.append(data[kept[-1] if kept else 0 :])
    return [(data, Chunked(data, [e + (kept[-1] if kept else 0) for e in tail.ends], kept, parts)) for (data, kept, parts), tail in zip(made, chunk_all(tails))]


OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(docs: DataFrame, parts: int) -> DataFrame:
    """docs with columns part and head: ranges of key, each followed by the first row of the next range as its head."""
    spark = docs.sparkSession
    bounds = docs.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 10000).alias("b")).head()["b"] if parts > 1 else []
    bounds = sorted(set(bounds or []))  # one number for each range
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.array(*map(F.lit, bounds[::step])), F.array(*map(F.lit, bounds))
    if bounds:
        over = F.size(F.filter(coarse, lambda b: b <= F.col("key")))
        first = F.greatest((over - 1) * step, F.lit(0))
        part = first + F.size(F.filter(F.slice(fine, first + 1, F.lit(step)), lambda b: b <= F.col("key")))
    else:
        part = F.lit(0)
    dealt = docs.withColumn("part", part.cast("int"))
    firsts = [tuple(r) for r in dealt.groupBy("part").agg(F.min("key")).collect()]  # one row for each range
    firsts.sort()
    heads = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    heads = spark.createDataFrame(heads, "head_key bigint, head_of int")
    both = dealt.join(F.broadcast(heads), F.col("key") == F.col("head_key"), "left")
    own, head = F.struct(F.col("part").alias("part"), F.lit(False).alias("head")), F.struct(F.col("head_of").alias("part"), F.lit(True).alias("head"))
    places = F.when(F.col("head_of").isNull(), F.array(own)).otherwise(F.array(own, head))
    return both.select("*", F.explode(places).alias("place")).select("id", "key", "text", "place.part", "place.head")


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, block: int = 256) -> DataFrame:
    """Fingerprints of every row's text and edited text, with the containment of the first in the edited and the next text."""
    spark = docs.sparkSession
    parts = ranges or 4 * shuffle_width(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}: documents follow each other by whole numbers")
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, text) of a range, the last of them still without its successor
        at = None

        def made(group: list[tuple]) -> pa.RecordBatch:
            """Rows for all of group but the last, which is only a successor."""
            chunks = chunk_all([t.encode() for _, t in group])
            edited = _edited([(c, t, f) for c, (_, t), (_, f) in zip(chunks, group, group[1:])])
            rows = [
                (i, len(t), hashlib.sha256(data).hexdigest(), c.fingerprint(), e.fingerprint(), containment(c, e), containment(c, after))
                for (i, t), c, (data, e), after in zip(group, chunks, edited, chunks[1:])
            ]
            return pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows), types)], names)

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        over = False
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for i, text, part, head in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if part != at:
                    held, at, over = [], part, False
                if over:
                    continue
                held.append((i, text))
                over = head  # a range ends with its first head
                if len(held) > 1 and (head or len(held) > block):
                    yield made(held)
                    held = held[-1:]

    dealt = _ranges(rows, parts).repartition(shuffle_width(spark), "part").sortWithinPartitions("part", "head", "key", "text")
    return dealt.mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(documents(spark, sf_dir, "doc_id", "text"))
