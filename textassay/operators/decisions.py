"""Conformal calibration, drift windows, folds and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import counted, numbered, running, value_at


def conformal_quantiles(scores: DataFrame, score: str, delta: float | list[float], *by: str) -> DataFrame:
    """Three thresholds at miscoverage delta: interpolated at (1 - delta)(n + 1), linear, and the ceiling's element. With
    a list of deltas, a row for each, under `delta`."""
    deltas = delta if isinstance(delta, list) else [delta]
    own = ["delta"] if isinstance(delta, list) else []
    n, keep = F.col("n"), 1 - F.col("delta")
    ranked = counted(scores.withColumn("v", F.col(score)).select(*by, "v"), "v", *by).withColumnRenamed("all_c", "n")
    placed = ranked.withColumn("delta", F.explode(F.array(*map(F.lit, deltas))))
    rank = keep * (n + 1)
    whole = F.least(F.greatest(F.floor(rank), F.lit(1)), n)
    linear = keep * (n - 1)
    low = F.floor(linear) + 1
    at = lambda k: value_at(k - 1, "v")
    found = placed.groupBy(*by, "delta").agg(
        F.max("n").alias("n"), at(whole).alias("a"), at(F.least(whole + 1, n)).alias("b"), F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rank - whole))).alias("s"),
        at(low).alias("c"), at(F.least(low + 1, n)).alias("d"), F.max(linear - F.floor(linear)).alias("l"), at(F.least(F.ceil(F.round(rank, 9)), n)).alias("e"),
    )
    return found.select(
        *by, *own, "n", F.round(F.col("a") + F.col("s") * (F.col("b") - F.col("a")), 9).alias("q_interpolated"), F.round(F.col("c") + F.col("l") * (F.col("d") - F.col("c")), 9).alias("q_linear"), F.col("e").alias("q_ceiling")
    )


def conformal_decision(score: Column, threshold: Column, margin: float = 0.05, three_way: bool = True) -> Column:
    out = F.when(score <= threshold, "ACCEPT")
    if three_way:
        out = out.when(score <= threshold + margin, "ESCALATE")
    return out.otherwise("REJECT")


def last_n(rows: DataFrame, n: int, order: str, *by: str) -> DataFrame:
    """The newest n rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def ewma(rows: DataFrame, value: str, order: list[str], alpha: float, *by: str) -> DataFrame:
    """Exponentially weighted mean of each group in order, seeded by its first value. A row's weight follows from its rank
    and the group's size, so the mean is one sum, combined before it moves."""
    ranked = numbered(rows, order, *by, rank="__r", n="__n")
    weight = F.when(F.col("__r") == 0, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), (F.col("__n") - 1 - F.col("__r")).cast("double"))
    return ranked.groupBy(*by).agg(F.max("__n").alias("n"), F.sum(weight * F.col(value)).alias("ewma"))


def vote(accepts: list[Column], confidences: list[Column], need: int) -> Column:
    """struct<accepted, votes, confidence>: accepted with need votes or more; confidence sums accepted ones over all."""
    votes = sum((a.cast("int") for a in accepts[1:]), accepts[0].cast("int"))
    total = sum((F.when(a, c).otherwise(0.0) for a, c in zip(accepts[1:], confidences[1:])), F.when(accepts[0], confidences[0]).otherwise(0.0))
    return F.struct((votes >= need).alias("accepted"), votes.alias("votes"), (total / len(accepts)).alias("confidence"))


def adaptive_need(accuracy: Column) -> Column:
    """Votes asked of three strategies by their observed accuracy."""
    return F.when(accuracy >= 0.90, 2).when(accuracy >= 0.75, 3).otherwise(3)


def contiguous_thirds(rows: DataFrame, order: str) -> DataFrame:
    """rows with third: 0, 1 or 2 of the rows in order; the last takes the remainder. Rows of one value stay together, and
    null values come first."""
    counts = running(rows.groupBy(F.col(order).alias("__v")).agg(F.count(F.lit(1)).alias("__c")), "__v", ["__c"])
    third = F.least(F.lit(2), F.floor(F.col("before___c") / F.greatest(F.floor(F.col("all___c") / 3), F.lit(1))))
    return rows.join(counts.select("__v", third.cast("int").alias("third")), F.col(order).eqNullSafe(F.col("__v"))).drop("__v")
