"""Ranks, running sums, exact quantiles and sliding windows over groups that no task could hold.

Rows are dealt to ranges of (group, order) at sampled bounds and written down, so that a row's range is fixed. The sums of
each range are few; a window over them gives every range its offset, and a window inside each range does the rest. A group
may lie in one range or in all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def _width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def running(rows: DataFrame, order: str | Sequence[str], sums: Sequence[str], *by: str) -> DataFrame:
    """rows with before_<c>, the sum of c over the group's rows that come earlier in order, and all_<c>, over all of them.

    Rows of a group that are equal in order follow each other in no stated order. Nulls in order come first; a null group
    is a group.
    """
    order = [order] if isinstance(order, str) else list(order)
    dealt = staged(rows.repartitionByRange(_width(rows), *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    keys = [f"__by{k}" for k in range(len(by))]
    per = dealt.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col("__part").alias("__range")).agg(*(F.sum(c).alias(c) for c in sums))  # a row for each range, and one more for each group
    upto, every = Window.partitionBy(*keys).orderBy("__range"), Window.partitionBy(*keys)
    offsets = per.select(*keys, "__range", *((F.sum(c).over(upto) - F.col(c)).alias(f"__o_{c}") for c in sums), *(F.sum(c).over(every).alias(f"all_{c}") for c in sums))
    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)), F.col("__part") == F.col("__range"))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(offsets, same)
    before = [(F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) - F.coalesce(c, F.lit(0))).alias(f"before_{c}") for c in sums]
    return joined.select(*rows.columns, *before, *(f"all_{c}" for c in sums))


def counted(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, c, before_c, all_c): rows counted by value, with how many lie below and how many there are. Null values are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    return running(counts, value, ["c"], *by)


def value_at(rank: Column, value: str) -> Column:
    """Over rows of `counted`: the value of this rank, from 0."""
    return F.min(F.when((F.col("before_c") <= rank) & (rank < F.col("before_c") + F.col("c")), F.col(value)))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles, interpolated between the two nearest values, by group; null values are left out."""
    n = F.col("all_c")
    found, out = [], []
    for name, p in shares.items():
        place = F.lit(p) * (n - 1)
        low = F.floor(place)
        found += [value_at(low, value).alias(f"{name}__a"), value_at(F.least(low + 1, n - 1), value).alias(f"{name}__b"), F.max(place - low).alias(f"{name}__s")]
        a, b, s = (F.col(f"{name}__{x}") for x in "abs")
        out.append((a + s * (b - a)).alias(name))
    return counted(rows, value, *by).groupBy(*by).agg(*found).select(*by, *out)


def numbered(rows: DataFrame, order: str | Sequence[str], *by: str, rank: str = "rank", n: str = "n") -> DataFrame:
    """rows with their rank in the group, from 0, and the group's size. order should tell a group's rows apart."""
    found = running(rows.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], *by)
    return found.withColumnsRenamed({"before___one": rank, "all___one": n}).drop("__one")


def sliding(rows: DataFrame, order: str | Sequence[str], before: int, *by: str, block: int = 100_000) -> tuple[DataFrame, Window]:
    """rows dealt to blocks of a group's ranks, each with copies of the `before` rows ahead of it, and the window that
    holds each row and the `before` rows ahead. Keep the rows where `own` once the window has been used."""
    block = max(block, before)
    ranked = numbered(rows, order, *by, rank="__rank", n="__n")
    at = F.floor(F.col("__rank") / block)
    late = F.col("__rank") % block >= block - before
    places = F.when(late, F.array(F.struct(at.alias("b"), F.lit(True).alias("own")), F.struct((at + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("b"), F.lit(True).alias("own"))))
    dealt = ranked.withColumn("__p", F.explode(places)).select(*rows.columns, "__rank", F.col("__p.b").alias("__block"), F.col("__p.own").alias("own"))
    return dealt, Window.partitionBy(*by, "__block").orderBy("__rank").rowsBetween(-before, 0)
