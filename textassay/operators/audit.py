"""Audit structures: hash chains, Merkle roots, batch roots and canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .folds import Chain, Digest, ordered_fold
from .ranks import numbered


def hash_chain(rows: DataFrame, entry_hash: str, order: list[str], *by: str) -> DataFrame:
    """Root of each segment: the fold of sha256(root || hash) over raw bytes in order, from 32 zero bytes."""
    return ordered_fold(rows.select(*by, *order, F.unhex(entry_hash).alias("__h")), "__h", order, Chain, *by, name="root")


def merkle_root(leaves: Column) -> Column:
    """Root over an array of hashes: pairs of hexadecimal strings hashed, an odd last one doubled; 64 zeros if empty."""

    def up(level: Column) -> Column:
        n = F.size(level)
        pair = lambda i: F.sha2(F.concat(F.element_at(level, 2 * i - 1), F.element_at(level, F.least(2 * i, n))), 256)
        return F.when(n <= 1, level).otherwise(F.transform(F.sequence(F.lit(1), F.ceil(n / 2).cast("int")), pair))

    levels = F.greatest(F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(2)).cast("double"))), F.lit(1)).cast("int") + 1  # one more than enough: a root stays a root
    root = F.aggregate(F.sequence(F.lit(1), levels), leaves, lambda a, _: up(a))
    return F.when(F.size(leaves) == 0, "0" * 64).otherwise(F.element_at(root, 1))


#: Levels made in one step: a block of 2^LEVELS nodes becomes one, and no task gathers more.
LEVELS = 10


def _climb(nodes: Column, total: Column) -> Column:
    """The levels over a block of nodes, of a level that has `total` in all; none above the root."""

    def up(level: Column) -> Column:
        n = F.size(level)
        return F.transform(F.sequence(F.lit(1), F.ceil(n / 2).cast("int")), lambda i: F.sha2(F.concat(F.element_at(level, 2 * i - 1), F.element_at(level, F.least(2 * i, n))), 256))

    more = lambda k: F.ceil(total / F.pow(F.lit(2.0), (k - 1).cast("double"))) > 1
    step = lambda levels, k: F.concat(levels, F.array(F.when(more(k), up(F.element_at(levels, -1))).otherwise(F.array().cast("array<string>"))))
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), step), 2, LEVELS)


def merkle_tree(rows: DataFrame, leaf: str, order: list[str], *by: str) -> DataFrame:
    """(by, level, index, hash, leaves) of every node of each group's tree over its hexadecimal leaf hashes in order; an odd
    last node is paired with itself. A group's tree is made in blocks by many tasks, ten levels a step."""
    base = numbered(rows.select(*by, *order, F.col(leaf).alias("hash")), order, *by, rank="index", n="leaves").select(*by, F.lit(0).alias("level"), "index", "hash", "leaves")
    base = staged(base, "merkle-0")
    levels, at, low, most = [base], base, 0, base.agg(F.max("leaves")).head()[0] or 0
    while most > 1:
        n = F.ceil(F.col("leaves") / float(1 << low))
        blocks = at.filter(n > 1).groupBy(*by, F.shiftright("index", LEVELS).alias("__b")).agg(F.array_sort(F.collect_list(F.struct("index", "hash"))).alias("x"), F.max("leaves").alias("leaves"))
        climbed = blocks.select(*by, "__b", "leaves", F.posexplode(_climb(F.transform("x", lambda x: x["hash"]), n)).alias("l", "nodes")).select(*by, "__b", "leaves", "l", F.posexplode("nodes").alias("p", "hash"))
        index = F.expr(f"shiftleft(__b, {LEVELS - 1} - l) + p")
        made = staged(climbed.select(*by, (F.col("l") + low + 1).alias("level"), index.alias("index"), F.unhex("hash").alias("hash"), "leaves"), "merkle").withColumn("hash", F.lower(F.hex("hash")))
        levels.append(made)
        low, most = low + LEVELS, (most + (1 << LEVELS) - 1) >> LEVELS
        at = made.filter(F.col("level") == low)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def merkle_roots_of(tree: DataFrame, *by: str) -> DataFrame:
    return tree.groupBy(*by).agg(F.max("leaves").alias("leaves"), F.max_by("hash", "level").alias("root"))


def merkle_proofs(tree: DataFrame, *by: str, of: Column | None = None) -> DataFrame:
    """(by, index, hash, leaves, proof, root) of the leaves (those that `of` selects): the hashes to be joined on the way up, and
    where it ends. Siblings lie in a leaf's own block of 2^LEVELS nodes up to the block's top, and from there on the proof is
    the top's own: a leaf moves once, whatever its tree's size, and a proof not at all."""
    top = tree.agg(F.max("level")).head()[0] or 0
    above = None
    for low in reversed(range(0, top + 1, LEVELS)):
        at = tree.filter(F.col("level") == low)
        blocks = at.groupBy(*by, F.shiftright("index", LEVELS).alias("__b")).agg(F.array_sort(F.collect_list(F.struct("index", "hash"))).alias("x"), F.max("leaves").alias("leaves"))
        own, known = F.transform("x", lambda x: x["hash"]), (F.array().cast("array<string>"), F.lit(None).cast("string"))
        if above is not None:
            same = F.col("__b") == F.col("__top")
            for k, b in enumerate(by):
                same &= F.col(b).eqNullSafe(F.col(f"__by{k}"))
            blocks = blocks.join(above.select(*(F.col(b).alias(f"__by{k}") for k, b in enumerate(by)), F.col("index").alias("__top"), F.col("proof").alias("__proof"), F.col("root").alias("__root")), same, "left")
            known = F.coalesce("__proof", known[0]), F.col("__root")
        made = blocks.select(*by, "__b", "leaves", own.alias("x"), _climb(own, F.ceil(F.col("leaves") / float(1 << low))).alias("up"), known[0].alias("__proof"), known[1].alias("__root"))
        made = made.select(*by, "__b", "leaves", "x", F.concat(F.array("x"), F.filter("up", lambda u: F.size(u) > 0)).alias("levels"), "__proof", "__root")
        joined = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.ceil(F.col("leaves") / F.pow(F.lit(2.0), (k + low).cast("double"))) > 1)  # levels that are not yet the root

        def path(p: Column) -> Column:
            beside = lambda k: F.call_function("shiftright", p, k).bitwiseXOR(F.lit(1))
            level = lambda k: F.element_at("levels", k + 1)
            return F.concat(F.transform("__joined", lambda k: F.element_at(level(k), F.least(beside(k), F.size(level(k)) - 1) + 1)), F.col("__proof"))

        root = F.coalesce("__root", F.element_at(F.element_at("levels", -1), 1)).alias("root")
        paths = F.transform("x", lambda h, p: F.struct(h.alias("hash"), path(p).alias("proof")))
        made = made.withColumn("__joined", joined).select(*by, "__b", "leaves", root, F.posexplode(paths).alias("__p", "__x"))
        above = made.select(*by, F.lit(low).alias("level"), F.expr(f"shiftleft(__b, {LEVELS}) + __p").alias("index"), F.col("__x.hash").alias("hash"), "leaves", F.col("__x.proof").alias("proof"), "root")
        if low:
            above = staged(above, "merkle-proofs")  # a thousandth of the leaves
    return (above if of is None else above.filter(of)).drop("level")


def proved_root(leaf: Column, index: Column, proof: Column) -> Column:
    """The root that a leaf's proof leads to."""
    start = F.struct(leaf.alias("h"), index.cast("bigint").alias("i"))
    pair = lambda a, s: F.when(a["i"] % 2 == 0, F.concat(a["h"], s)).otherwise(F.concat(s, a["h"]))
    return F.aggregate(proof, start, lambda a, s: F.struct(F.sha2(pair(a, s), 256).alias("h"), F.shiftright(a["i"], 1).alias("i")))["h"]


def batch_root(rows: DataFrame, root: str, order: str, *by: str) -> DataFrame:
    """sha256 of the hexadecimal roots, concatenated in order."""
    return ordered_fold(rows.select(*by, order, F.col(root).cast("binary").alias("__h")), "__h", [order], Digest, *by, name="batch_root").drop("entries")


def canonical_json(fields: dict[str, Column], decimals: int = 9) -> Column:
    """A flat JSON object with sorted keys and numbers at a fixed number of decimals; strings are escaped."""
    parts = []
    for name in sorted(fields):
        c = fields[name]
        parts += [F.lit(f'{"," if parts else ""}"{name}":'), c]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_number(c: Column, decimals: int = 9) -> Column:
    return F.format_string(f"%.{decimals}f", F.round(c, decimals))


def json_text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
