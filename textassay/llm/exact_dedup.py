"""Exact deduplication by distributed most-significant-digit radix partitioning.

All texts start in one group. A round reads the next digit, a run of successive bytes, of every text that is
still undecided and splits each group by it. A text alone in its group is decided; so is a group whose texts end
within the digit, since equal digits shorter than the digit's width mean equal, ended texts. The others keep what
follows the digit and go to the next round. Texts are compared byte by byte and never by digest. Digits widen
geometrically, so the longest text takes a logarithmic number of rounds.

A round counts its groups with map-side combining, so a group holding a third of the corpus is a few partial rows;
only groups of two or more rows are kept, staged and joined back to the undecided texts. That join is a
shuffled hash join on two plain exchanges, which adaptive execution splits where one group is hot.

Defined results: a null text is an empty text; null ids never win over others (a group of only null ids has a null
keep_id and keeps its rows); rows repeating the id and text of the row that stays are marked dropped but one;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_side, stage, unstage


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = 256, growth: int = 16, max_width: int = 1 << 20
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    live = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.lit(0).cast("long").alias("gid"), text.alias("rest"))
    width, done, used = first_width, [], []
    while True:
        keyed = live.select("id", "sha", "gid", F.expr(f"substring(rest, 1, {width})").alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        groups = stage(
            keyed.groupBy("gid", "digit")
            .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
            .filter("n > 1")
            .select("gid", "digit", "n", "keep", F.monotonically_increasing_id().alias("sub")),
            "radix-groups",
        )
        split = stage(
            keyed.join(groups.hint("shuffle_hash"), ["gid", "digit"], "left").select(
                "id",
                "sha",
                F.coalesce("n", F.lit(1).cast("long")).alias("n"),
                F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
                (open_ := F.col("n").isNotNull() & (F.length("digit") >= width)).alias("open"),
                F.when(open_, F.col("sub")).alias("gid"),
                F.when(open_, F.col("rest")).alias("rest"),
            ),
            "radix-round",
        )
        done.append(split.filter("not open").select("id", "sha", "n", "keep"))
        unstage(groups, *used)
        live, used = split.filter("open").select("id", "sha", "gid", "rest"), []
        if live.isEmpty():
            break
        width = min(width * growth, max_width)
    found = reduce(DataFrame.unionAll, done).withColumn("kept", F.col("id").eqNullSafe(F.col("keep")))
    again = found.filter("kept and id is not null and n > 1").groupBy("id", "sha").count().filter("count > 1").drop("count")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() * 64 <= 8 << 20 else again
        mark = again.withColumn("repeated", F.lit(True))
        found = found.join(mark, ["id", "sha"], "left")
        w = Window.partitionBy("id", "sha").orderBy("keep")
        first = found.filter("repeated and kept").withColumn("kept", F.row_number().over(w) == 1)
        found = found.filter("repeated is null or not kept").unionByName(first)
    return found.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each different text, with docs' columns."""
    decided = stage(exact_dedup(docs.select(id_col, text_col), id_col, text_col), "exact-decided")
    gone = decided.filter("not kept").select(F.col(id_col).alias("__gone_id"), F.col("text_sha256").alias("__gone_sha")).distinct()
    stays = decided.filter("kept").select(F.col(id_col).alias("__gone_id"), F.col("text_sha256").alias("__gone_sha"))
    twice = gone.join(stays, ["__gone_id", "__gone_sha"], "left_semi")  # ids repeated with their text: one row of each stays
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    marked = docs.withColumn("__sha", sha)
    on = lambda right: marked[id_col].eqNullSafe(right["__gone_id"]) & (marked["__sha"] == right["__gone_sha"])
    gone = stage(gone, "exact-gone")
    kept = marked.join(small_side(gone, 128), on(gone), "left_anti").drop("__sha")
    twice = stage(twice, "exact-twice")
    if twice.isEmpty():
        return kept
    return kept.unionByName(marked.join(twice, on(twice), "left_semi").dropDuplicates([id_col, "__sha"]).drop("__sha"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
