"""A trie over the turns of conversations, by chained prefix digests.

A turn's digest is the SHA-256 of its role and text; a prefix's digest is that of the prefix one turn shorter followed
by the turn's. So texts never travel: a turn is 32 bytes and a length from the scan on. Conversations are dealt by the
conversation whose first turns they take over, which comes first among them; one sorted pass then puts turns in order,
rebuilds every conversation and chains its digests, holding a few digests whatever the length of a conversation.

Equal conversations are counted as one with a weight before their prefixes are exploded. Grouping (depth, digest) gives
the nodes; a node's smallest member is its holder. The nodes that one conversation holds are the lower end of its chain,
so what they give to their ancestors is summed along the chain (a window that spills) and each of the chain's prefixes
gets one row: every node reaches all its ancestors, without a row for each pair. The parent's holder is read from the
same chain.

The digest of a node's ends needs its ids in order, however many. Ids are dealt in sorted ranges of (node, id); a group
inside a range is hashed as it passes, and groups that cross ranges, or exceed `PIECE` ids, pass on as joined pieces which
one more sorted pass feeds to the hash. A hash is sequential, but nothing is gathered.

Defined results: null roles and texts are empty; rows with a null conv_id belong to no conversation; turns of equal
number are ordered by role, then by the turn's digest, and repeated rows are turns of their own; conv_ids must be
integers, and c % 100 takes the sign of c; an empty table has no root and gives no rows; texts and conversations of any
length are whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stage, unstage

PIECE = 1 << 16
ROOT = hashlib.sha256(b"").digest()
SHARE, MOST_TAKEN = 100, 6


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of every rebuilt conversation, from rows sorted by base, conversation (the base first) and turn."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
    names = ["conv_id", "depth", "digest", "chars", "last"]
    at_base = conv = None
    shared: list[tuple[bytes, int]] = []
    take = place = depth = 0
    digest, chars = ROOT, 0
    out: list[tuple] = []

    def add(turn: bytes, n: int) -> None:
        nonlocal depth, digest, chars
        if depth:
            out.append((conv, depth, digest, chars, False))
        depth, digest, chars = depth + 1, hashlib.sha256(digest + turn).digest(), n

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        for base, c, turn, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if c != conv:
                if conv is not None:
                    out.append((conv, depth, digest, chars, True))
                if base != at_base:
                    at_base, shared = base, []
                conv, place, depth, digest, chars = c, 0, 0, ROOT, 0
                take = 0 if c == base else crc32(str(c).encode()) % MOST_TAKEN
                for x in shared[:take]:
                    add(*x)
            if c == base and len(shared) < MOST_TAKEN - 1:
                shared.append((turn, n))
            if place >= take:
                add(turn, n)
            place += 1
        if out:
            yield made()
            out.clear()
    if conv is not None:
        out.append((conv, depth, digest, chars, True))
        yield made()


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars of the last turn, last) of every prefix of at least a turn; a turnless conversation
    has one row, of depth 0. One row of each conversation is `last`."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    c = F.col("conv_id").cast("long")
    rows = conversations.where(c.isNotNull()).select(
        (c - c % SHARE).alias("base"),
        c.alias("conv_id"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("t"),
        F.char_length(text).cast("long").alias("n"),
        F.col("turn").alias("turn"),
        role.alias("role"),
    )
    dealt = rows.repartition(shuffle_width(conversations.sparkSession), "base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "t")
    return dealt.select("base", "conv_id", "t", "n").mapInArrow(_chains, "conv_id bigint, depth int, digest binary, chars bigint, last boolean")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the groups that lie within this range; pieces of joined ids of those that may not."""
    names, kinds = ["digest", "first_id", "piece", "sha256"], [pa.binary(), pa.int64(), pa.string(), pa.string()]
    key, ids, whole = None, [], False  # whole: all of key's ids are in ids
    out: list[tuple] = []

    def pass_on() -> None:
        out.append((key, ids[0], ",".join(map(str, ids)), None))

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        for digest, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != key:
                if key is not None:
                    if whole:
                        out.append((key, ids[0], None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
                    else:
                        pass_on()
                key, ids, whole = digest, [], key is not None
            elif len(ids) == PIECE:
                pass_on()
                ids, whole = [], False
            ids.append(c)
        if out:
            yield made()
            out.clear()
    if key is not None:
        pass_on()
        yield made()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash for each run of pieces."""
    key = running = None
    for batch in batches:
        done = []
        for digest, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = digest, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.string()))], ["digest", "sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["digest", "sha256"])


def id_hashes(ends: DataFrame) -> DataFrame:
    """For each digest of (digest, conv_id) rows, the SHA-256 of its ids, ascending and joined by commas."""
    width = shuffle_width(ends.sparkSession)
    dealt = ends.repartitionByRange(width, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    part = stage(dealt.mapInArrow(_pieces, "digest binary, first_id bigint, piece string, sha256 string"), "trie-ends")
    crossing = part.where(F.col("piece").isNotNull()).repartition(width, "digest").sortWithinPartitions("digest", "first_id").select("digest", "piece")
    return part.where(F.col("piece").isNull()).select("digest", "sha256").unionByName(crossing.mapInArrow(_joined, "digest binary, sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: its smallest member, depth, parent, members, children, leaves below, tokens saved below, and
    the digest of the ids that end there."""
    chains = stage(prefixes(conversations), "trie-chains")
    ends = chains.where("last").select("digest", "conv_id")
    total = ends.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).head()
    different = ends.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")).drop("digest")
    apart = stage(chains.where("depth > 0").join(different, "conv_id"), "trie-prefixes")
    nodes = apart.groupBy("depth", "digest").agg(F.min("conv_id").alias("holder"), F.sum("weight").alias("n_convs"), F.max(~F.col("last")).alias("goes_on"))
    nodes = stage(nodes, "trie-counts")  # joined by exchanges of their own, which adaptive execution splits where a node is in many chains
    chain = Window.partitionBy("conv_id").orderBy(F.desc("depth"))  # from the end up
    held = F.col("holder") == F.col("conv_id")
    on_chain = apart.join(nodes, ["depth", "digest"]).select(
        "depth",
        "digest",
        "conv_id",
        "n_convs",
        held.alias("held"),
        F.lead("holder").over(chain).alias("parent"),
        F.lag(held.cast("long"), 1, 0).over(chain).alias("child"),
        F.first(held).over(chain).alias("holds"),
        F.first((held & ~F.col("goes_on")).cast("long")).over(chain).alias("leaf"),
        F.sum(F.when(held, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)).over(chain.rowsBetween(Window.unboundedPreceding, 0)).alias("saved"),
    )
    own = F.col("held")
    sums = [F.sum(c).alias(n) for c, n in (("child", "n_children"), ("leaf", "n_leaves"), ("saved", "saved_tokens"))]
    firsts = [F.max(F.when(own, F.col(c))).alias(n) for c, n in (("conv_id", "conv_id"), ("parent", "parent_conv_id"), ("n_convs", "n_convs"))]
    below = stage(on_chain.where("holds").groupBy("depth", "digest").agg(*sums, *firsts), "trie-nodes")
    unstage(apart, nodes)
    columns = ["digest", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    least = F.lit(total["least"]).cast("long")
    root = below.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = root.where(F.lit(total["n"] > 0)).select(
        F.lit(ROOT).alias("digest"), least.alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    found = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", least)).select(*columns).unionByName(root.select(*columns))
    out = found.join(id_hashes(ends), "digest", "left")
    return out.withColumn("ends_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("digest", "sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', role, text))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id AS c, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes FROM turns),
taken AS (SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 6 AS h FROM ids),
rebuilt AS (SELECT c, pos, role, text FROM taken JOIN turns ON conv_id = c - c % 100 AND pos < h
  UNION ALL SELECT c, pos, role, text FROM taken JOIN turns ON conv_id = c AND pos >= h),
chains AS (SELECT c, row_number() OVER p AS depth, sha256(CAST(list([role, text]) OVER p AS VARCHAR)) AS k, length(text) AS chars FROM rebuilt WINDOW p AS (PARTITION BY c ORDER BY pos)
  UNION ALL SELECT c, 0, '', 0 FROM taken),
numbered AS (SELECT *, max(depth) OVER (PARTITION BY c) AS deepest FROM chains),
nodes AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, max(deepest) > depth AS goes_on,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = deepest), '')) AS ends_sha256 FROM numbered GROUP BY depth, k),
upward AS (SELECT a.depth, a.k, n.depth - a.depth AS up, (n.n_convs - 1) * n.chars AS saved, n.goes_on FROM nodes n JOIN chains a ON a.c = n.conv_id AND a.depth <= n.depth),
sums AS (SELECT depth, k, count(*) FILTER (WHERE up = 1) AS n_children, count(*) FILTER (WHERE NOT goes_on) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM upward GROUP BY depth, k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (depth, k) LEFT JOIN chains up ON up.c = n.conv_id AND up.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = up.depth AND p.k = up.k
"""
