"""Near-deduplication by SimHash fingerprints and a byte-position inverted index with count filtering.

Two 64-bit fingerprints at most two bits apart agree in at least six of their eight bytes. The index therefore posts
every different fingerprint under positional bytes: the eight positions are taken as four pairs, and each of the six
choices of two pairs (four positions with their bytes) is a posting list. A pair agreeing in six bytes meets in one
of them at least. Within a list a pair's shared positional bytes are tallied, pairs below the guaranteed six are
dropped, and the rest are verified by their differing bits.

Lists stay linear. A list of more than `dense` fingerprints is not paired but posted again under two more
positions, six bytes in all; a list dense even then holds fingerprints that differ in 16 bits only, and each of these
meets its one-bit neighbours: two values at most two bits apart share such a neighbour, so every member is linked
to the smallest member of each neighbourhood. This is exact and gives up no link that matters to the components.

Defined results: a null or blank text has fingerprint zero and is linked like any other; texts of one or two words
hash as one shingle; repeated rows get equal rows; null ids get their component but never name one; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, small_side, stage, unstage
from .components import connected_components

SEED = 42
MOST_BITS = 2
LEAST_BYTES = 8 - MOST_BITS


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=">u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8", count=max(1, len(words) - size + 1))


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles as a signed 64-bit integer."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def simhash(text: bytes, size: int = 3) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    return print_of(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((simhash(x.as_buffer().to_pybytes(), size) for x in texts), pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _two_bytes(fp: Column, pair: int) -> Column:
    return F.shiftrightunsigned(fp, 48 - 16 * pair).bitwiseAND(F.lit(0xFFFF))


def _one_byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(0xFF))


def _verified(x: Column) -> Column:
    tally = reduce(Column.__add__, ((_one_byte(x, i) == 0).cast("int") for i in range(8)))
    return (tally >= LEAST_BYTES) & (F.bit_count(x) <= MOST_BITS)


def _paired(postings: DataFrame) -> DataFrame:
    """Links within posting lists of bounded length."""
    a, b = postings.alias("a"), postings.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _verified(x)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _split(postings: DataFrame, dense: int) -> tuple[DataFrame, DataFrame | None]:
    """Postings of lists up to dense long, and of the others (None if there are none)."""
    long = stage(postings.groupBy("key").count().filter(F.col("count") > dense).select("key"), "simhash-dense")
    if long.isEmpty():
        return postings, None
    long = small_side(long, 64)
    return postings.join(long, "key", "left_anti"), postings.join(long, "key", "left_semi")


def links(different: DataFrame, dense: int = 64) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs of fingerprints at most two bits apart.

    different: one row (fp) for each fingerprint.
    """
    fp = F.col("fp")
    choices = list(combinations(range(4), 2))
    keys = [(F.lit(k) * F.lit(1 << 32) + _two_bytes(fp, i) * F.lit(1 << 16) + _two_bytes(fp, j)) for k, (i, j) in enumerate(choices)]
    postings = stage(different.select(F.explode(F.array(*keys)).alias("key"), "fp"), "simhash-postings")
    short, long = _split(postings, dense)
    found = [_paired(short)]
    if long is not None:
        rest = [[p for pair in range(4) if pair not in c for p in (2 * pair, 2 * pair + 1)] for c in choices]
        choice = F.col("key") / F.lit(1 << 32)
        byte = [reduce(lambda a, k: F.when(F.floor(choice) == k, _one_byte(fp, rest[k][i])).otherwise(a), range(6), F.lit(None)) for i in range(4)]
        more = F.explode(F.array(*[F.struct(F.lit(10 * i + j).alias("at"), (byte[i] * 256 + byte[j]).alias("two")) for i, j in combinations(range(4), 2)]))
        finer = stage(long.select("key", "fp", more.alias("m")).select(F.struct("key", "m.at", "m.two").alias("key"), "fp"), "simhash-finer")
        short, long = _split(finer, dense)
        found.append(_paired(short))
        if long is not None:
            flips = [F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(63)), F.lit(-(1 << 63)).cast("long")]
            ball = long.select("key", "fp", F.explode(F.array(*flips)).alias("flip")).select("key", fp.bitwiseXOR(F.col("flip")).alias("centre"), "fp")
            ball = stage(ball, "simhash-ball")
            head = stage(ball.groupBy("key", "centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "simhash-heads")
            star = ball.join(head, ["key", "centre"]).filter("a < fp").select("a", F.col("fp").alias("b"))
            found.append(star.filter(_verified(F.col("a").bitwiseXOR(F.col("b")))))
    return stage(reduce(DataFrame.unionAll, found).distinct(), "simhash-links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, dense: int = 64) -> DataFrame:
    """One row per input row: id, fp and component_id, the smallest id reachable through links."""
    each = stage(fingerprints(docs, id_col, text_col, size), "simhash-prints")
    different = stage(each.groupBy("fp").agg(F.min("id").alias("least")), "simhash-different")
    pairs = links(different, dense)
    roots = connected_components(pairs)
    joined = stage(different.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-joined")
    least = stage(joined.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    classes = stage(joined.join(least, "root").select("fp", "component_id"), "simhash-classes")
    unstage(roots, pairs, joined, least, different)
    return each.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, dense: int = 64) -> DataFrame:
    """docs with one document of each group linked by a shingle similarity of 0.8, the one with the smallest id (rows repeating
    that id once). Links come from the fingerprints' index first and from an exact filter for what is further apart."""
    from .near_copies import similar_classes  # which uses the index above

    classes = stage(similar_classes(docs.select(id_col, text_col), id_col, text_col, size, dense), "simhash-groups")
    gone = stage(classes.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone_id")).distinct(), "simhash-gone")
    kept = docs.join(small_side(gone, 32), docs[id_col] == F.col("__gone_id"), "left_anti")
    twice = stage(classes.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("__twice_id")), "simhash-twice")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, kept[id_col] == F.col("__twice_id"), "left_semi").dropDuplicates([id_col])
    return kept.join(twice, kept[id_col] == F.col("__twice_id"), "left_anti").unionByName(again)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(documents(spark, sf_dir, "doc_id", "text"), size=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
