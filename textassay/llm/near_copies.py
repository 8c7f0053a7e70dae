"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least 0.8: SimHash, then an exact prefix filter.

The fingerprints of the shingles go through operator 2's index (`simhash.links`: positional bytes, tally, bits), and what it
brings together within two bits is verified by the whole sets. Two sets of similarity 0.8 may differ in many more bits, and
no radius is sure to hold them all, so the pairs further apart come from the filter; pairs that the index has
settled are not asked for again.

The shingles of every set are put in one common order, those often met in a sample of documents last and the others by
hash. Two sets of similarity 0.8 share one of their first n - ceil(0.8 n) + 1 shingles, so each set is posted under
these, and pairs that meet in a list are kept if their sizes and the places of the shared shingle still allow 0.8. The
order decides only how long lists are, never which pairs are found. Candidates whose parity signatures (the parities of the numbers of
shingles in four to eight classes a shingle) differ in more places than two such sets can are dropped, and the rest are
verified by their whole sets. A signature is a sixteenth of its set or less.

A list of more than `dense` sets makes no rows for its pairs: it is cut into blocks, each two blocks are compared in
one task by their signatures, and a task returns a spanning forest of its candidates, the likeliest edges first. Only
edges are verified by whole sets. Where one fails, its blocks' forests are built again without it and more candidates are
asked for, until all edges hold: so the forests' components are those of all links. This is exact, and work on signatures grows with the square of such a
list.

Shingles and sets are told apart by 64-bit hashes. Defined results: blank and null texts are copies of each other;
texts of fewer words than a shingle are one shingle; rows with a null id are in no group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import release, small_side, stage, unstage
from .components import connected_components
from .simhash import SEED, links, print_of, shingle_hashes

#: The similarity, 4 / 5.
NUM, DEN = 4, 5
SAMPLE = 4000
HEAVY = 20_000
BLOCK_SETS = 1024
ROUND = 32
ROWS = 256  # of a pair of blocks whose 64-bit numbers are held at a time
PARITIES = 4  # a shingle, at least


def _set_of(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.astype(np.uint64).view(np.int64))


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """The different shingles of a UTF-8 text as sorted signed 64-bit hashes."""
    return _set_of(shingle_hashes(text, size))


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def similar(na: Column, nb: Column, shared: Column) -> Column:
    return shared * (NUM + DEN) >= (na + nb) * NUM


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")).filter("id IS NOT NULL")


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by their last bits, in the next power of two of PARITIES classes a shingle. Two
    sets' signatures differ in no more places than the sets do, nor do they once folded to fewer classes."""
    classes = 1 << max(6, (PARITIES * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount(shingles & (classes - 1), minlength=classes).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(sig: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of words) of as many words, a power of two times fewer."""
    return np.bitwise_xor.reduce(sig.reshape(len(sig), -1, words), axis=1)


def _places(x: bytes, y: bytes) -> int:
    """In how many places two signatures differ, the longer one folded."""
    a, b = (np.frombuffer(s, np.uint64)[None] for s in (x, y))
    words = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum())


def _nodes(texts: DataFrame, size: int) -> DataFrame:
    """(id, node, n, sig, fp) of every row."""

    def told(text: bytes) -> tuple[int, int, bytes, int]:
        hashes = shingle_hashes(text, size)
        s = _set_of(hashes)
        return node_of(s), len(s), signature(s), print_of(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, sigs, prints = zip(*(told(x.as_buffer().to_pybytes()) for x in batch.column(1))) if batch.num_rows else ([], [], [], [])
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "n", "sig", "fp"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, node bigint, n int, sig binary, fp bigint")


def _printed(prints: DataFrame, dense: int) -> DataFrame:
    """(a, b), a < b: what the index of fingerprints links, each fingerprint standing for its smallest set, and the sets of
    one fingerprint to that one."""
    heads = stage(prints.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c")), "near-heads")
    close = links(heads.select("fp"), dense)
    side = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}"))
    apart = close.join(side("a"), "a").join(side("b"), "b").select(F.col("head_a").alias("x"), F.col("head_b").alias("y"))
    same = prints.join(heads.filter("c > 1"), "fp").filter("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    out = stage(apart.unionAll(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "near-printed")
    unstage(heads, close)
    return out


def _candidates(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """pairs(a, b) whose signatures still allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = (batch.column(2).to_numpy() + batch.column(4).to_numpy().astype(np.int64)) * (DEN - NUM) // (DEN + NUM)
            apart = [_places(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(5))]
            yield batch.filter(pa.array(np.array(apart, np.int64) <= bound)).select(["a", "b"])

    side = lambda x: prints.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "sig_a", "n_b", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [shingle_set(x.as_buffer().to_pybytes(), size) for x in batch.column(1).slice(lo, 256)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(sets))], ["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles array<bigint>")


def _often(texts: DataFrame, size: int) -> np.ndarray:
    """At most HEAVY shingles of three or more sampled documents, the commonest last."""
    every = max(1, texts.count() // SAMPLE)
    counts = _sets(texts.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), size).select(F.explode("shingles").alias("s")).groupBy("s").count()
    found = counts.filter("count > 2").orderBy(F.desc("count"), "s").limit(HEAVY).collect()
    return np.array([r.s for r in reversed(found)], np.int64)


def _postings(texts: DataFrame, size: int, often: np.ndarray) -> DataFrame:
    """(key, node, n, pos): the first shingles of every set in the common order, with its size and their places."""
    by_hash = np.argsort(often)
    names = often[by_hash]

    def ordered(s: np.ndarray) -> np.ndarray:
        if not len(names):
            return s
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        rank = np.where(names[at] == s, by_hash[at], -1)
        return s[np.argsort(rank, kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [shingle_set(x.as_buffer().to_pybytes(), size) for x in batch.column(1).slice(lo, 256)]
                n = np.array([len(s) for s in sets], np.int32)
                first = np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)
                keys = np.concatenate([ordered(s)[:k] for s, k in zip(sets, first)])
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in first])
                nodes = np.fromiter(map(node_of, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, np.repeat(nodes, first), np.repeat(n, first), pos)], ["key", "node", "n", "pos"])

    return texts.mapInArrow(run, "key bigint, node bigint, n int, pos int")


FOREST = "key bigint, lo int, hi int, a bigint, b bigint"


def _forest(table: pa.Table) -> pa.Table:
    """A spanning forest of the candidates of one pair of blocks, by Boruvka rounds over differing places.

    Rows with `b` are edges settled before, n telling if they hold: those that do are joined from the start, the others
    are left out. Where an edge has failed, each set's ROUND likeliest candidates in other trees are asked for as well.
    """
    edge = ~np.array(table["b"].is_null())
    rows, settled = table.filter(pa.array(~edge)), table.filter(pa.array(edge))
    nodes, at = np.unique(rows["node"].to_numpy(), return_index=True)
    n = rows["n"].to_numpy()[at].astype(np.int64)
    sigs = [np.frombuffer(x, np.uint64) for x in rows["sig"].take(pa.array(at)).to_pylist()]
    words = np.array([len(x) for x in sigs])
    apart = np.full((len(nodes), len(nodes)), np.iinfo(np.int32).max, np.int32)
    for w in np.unique(words):  # sizes within the similarity are at most one folding apart
        own = np.flatnonzero((words == w) | (words == 2 * w))
        sig = np.vstack([_folded(sigs[k][None], w) for k in own])
        sums = np.zeros((len(own), len(own)), np.int32)
        for lo in range(0, len(own), ROWS):
            for word in sig.T:
                sums[lo : lo + ROWS] += np.bitwise_count(word[lo : lo + ROWS, None] ^ word)
        apart[np.ix_(own, own)] = np.where((words[own] == w)[:, None] | (words[own] == w), sums, apart[np.ix_(own, own)])
    never = np.iinfo(np.int32).max
    for lo in range(0, len(nodes), ROWS):
        some, own = apart[lo : lo + ROWS], n[lo : lo + ROWS, None]
        some[(some > (own + n) * (DEN - NUM) // (DEN + NUM)) | (np.minimum(own, n) * DEN < np.maximum(own, n) * NUM)] = never
    np.fill_diagonal(apart, never)
    root, links, asked = np.arange(len(nodes)), [], set()
    x, y = (np.searchsorted(nodes, settled[c].to_numpy()) for c in ("node", "b"))
    held = settled["n"].to_numpy() > 0
    apart[x[~held], y[~held]] = apart[y[~held], x[~held]] = never
    for p, q in zip(x[held], y[held]):
        root[root == max(root[p], root[q])] = min(root[p], root[q])
    if not held.all() and len(nodes) > 1:
        near = np.where(root[:, None] == root, never, apart)
        most = min(ROUND, len(nodes) - 1)
        likely = np.concatenate([np.argpartition(near[lo : lo + ROWS], most - 1, axis=1)[:, :most] for lo in range(0, len(near), ROWS)])
        for i, j in zip(*np.nonzero(np.take_along_axis(near, likely, axis=1) < never)):
            k = likely[i, j]
            asked.add((nodes[min(i, k)], nodes[max(i, k)]))
    while True:
        near = np.where(root[:, None] == root, never, apart)
        best = near.argmin(axis=1)
        least = near[np.arange(len(nodes)), best]
        order = np.lexsort((np.arange(len(nodes)), least, root))
        order = order[least[order] < never]
        if not len(order):
            break
        heads = order[np.append(True, root[order][1:] != root[order][:-1])]  # the nearest way out of each tree
        for i, j in zip(heads.tolist(), best[heads].tolist()):
            p, q = root[i], root[j]
            if p != q:
                root[root == max(p, q)] = min(p, q)
                links.append((nodes[min(i, j)], nodes[max(i, j)]))
    links = sorted(asked.union(links))
    head = [pa.array([table[c][0].as_py()] * len(links), t) for c, t in (("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))]
    return pa.table([*head, *(pa.array([e[k] for e in links], pa.int64()) for k in (0, 1))], names=["key", "lo", "hi", "a", "b"])


def _verified(edges: DataFrame, texts: DataFrame, prints: DataFrame, size: int) -> DataFrame:
    """edges(a, b) with ok: whether their whole sets have the similarity."""
    wanted = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = stage(prints.join(small_side(wanted, 32), "node", "left_semi").select(F.col("least").alias("id")).distinct(), "near-wanted")
    held = stage(_sets(texts.join(small_side(ids, 64), "id", "left_semi"), size), "near-sets")
    both = edges.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    ok = similar(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y")))
    out = stage(both.select("a", "b", ok.alias("ok")).distinct(), "near-verified")
    unstage(ids, held)
    release(texts.sparkSession)
    return out


def similar_links(texts: DataFrame, prints: DataFrame, size: int = 5, dense: int = 64) -> DataFrame:
    """Links (a, b) of set names whose components are those of all pairs of similarity 0.8.

    texts: (id, text), one row or more of each different set; prints: (node, least, n, sig, fp), the id of one of a set's rows,
    its size, its signature and a fingerprint.
    """
    spark = texts.sparkSession
    printed = _printed(prints, dense)
    close = stage(_candidates(printed, prints), "near-close")
    found = [_verified(close, texts, prints, size)]
    unstage(printed, close)
    postings = stage(_postings(texts, size, _often(texts, size)), "near-postings")
    lists = stage(postings.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-lists")
    few, many = lists.filter(F.col("m") <= dense).select("key"), lists.filter(F.col("m") > dense)
    met = stage(postings.join(small_side(few, 64), "key", "left_semi"), "near-met")
    a, b = met.alias("a"), met.alias("b")
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    sizes = F.least("a.n", "b.n") * DEN >= F.greatest("a.n", "b.n") * NUM
    meeting = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & sizes & similar(F.col("a.n"), F.col("b.n"), left)
    pairs = stage(a.join(b, meeting).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "near-pairs")
    edges = stage(_candidates(pairs, prints), "near-edges")
    crowd = None
    if not many.isEmpty():
        told = postings.select("key", "node").join(small_side(many.select("key", F.ceil(F.col("m") / BLOCK_SETS).cast("int").alias("blocks")), 64), "key").withColumn("mine", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        told = told.select("key", "node", "mine", other).select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node")
        crowd = stage(told.join(prints.select("node", "n", "sig"), "node").select("key", "lo", "hi", "node", F.lit(None).cast("bigint").alias("b"), "n", "sig"), "near-crowd")
    unstage(postings, met, lists, pairs)
    release(spark)
    asked, settled, open_ = edges, None, crowd
    while True:
        forest = None
        if open_ is not None:
            forest = stage(open_.groupBy("key", "lo", "hi").applyInArrow(_forest, FOREST), "near-forest")
            asked = forest.select("a", "b") if len(found) > 1 else edges.unionAll(forest.select("a", "b"))
        asked = asked.distinct()
        for done in found:
            asked = asked.join(done, ["a", "b"], "left_anti")
        asked = stage(asked, "near-asked")
        found.append(_verified(asked, texts, prints, size))
        unstage(asked)
        if forest is None:
            break
        told = stage(forest.join(reduce(DataFrame.unionAll, found), ["a", "b"]).select(*forest.columns, "ok"), "near-told")
        groups = stage(told.filter("not ok").select("key", "lo", "hi").distinct(), "near-groups")
        if groups.isEmpty():
            break
        settled = told if settled is None else settled.unionAll(told)
        known = settled.select("key", "lo", "hi", F.col("a").alias("node"), "b", F.col("ok").cast("int").alias("n"), F.lit(None).cast("binary").alias("sig"))
        open_ = crowd.unionAll(known).join(small_side(groups, 64), ["key", "lo", "hi"], "left_semi")
    out = stage(reduce(DataFrame.unionAll, found).filter("ok").select("a", "b").distinct(), "near-links")
    unstage(edges, *found, *([] if crowd is None else [crowd]))
    release(spark)
    return out


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, dense: int = 64) -> DataFrame:
    """One row per input row with an id: id and component_id, the smallest id reachable through links."""
    texts = _texts(docs, id_col, text_col)
    each = stage(_nodes(texts, size), "near-nodes")
    different = stage(each.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("fp").alias("fp")), "near-different")
    one, copies = texts, different.filter("c > 1")
    if not copies.isEmpty():  # one row of each different set will do; ids that stand for another set keep their rows
        gone = each.join(small_side(copies.select("node", "least"), 64), "node").filter(F.col("id") != F.col("least")).select("id").distinct()
        gone = stage(gone.join(different.select(F.col("least").alias("id")), "id", "left_anti"), "near-gone")
        one = texts.join(small_side(gone, 64), "id", "left_anti")
        if each.select("id").distinct().count() < each.count():
            one = one.dropDuplicates(["id", "text"])
    similar_pairs = similar_links(one, different.select("node", "least", "n", "sig", "fp"), size, dense)
    roots = connected_components(similar_pairs)
    joined = stage(different.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-joined")
    least = stage(joined.groupBy("root").agg(F.min("least").alias("component_id")), "near-least")
    classes = stage(joined.join(least, "root").select("node", "component_id"), "near-classes")
    unstage(roots, similar_pairs, joined, least, different)
    return each.select("id", "node").join(classes, "node").select(F.col("id").alias(id_col), "component_id")
