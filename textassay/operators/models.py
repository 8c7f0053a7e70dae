"""Weights, feature subsets, resampled means and attributions of scored rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .evaluation import _over, areas

Weights = tuple[float, ...]


def weighted(features: Sequence[str], weights: Column) -> Column:
    """Sum of features, each times its element of an array of weights."""
    return reduce(Column.__add__, (F.col(f) * weights[k] for k, f in enumerate(features)))


def scored_by(rows: DataFrame, features: Sequence[str], candidates: dict[str, Weights], truth: str = "truth") -> DataFrame:
    """(candidate, score, truth): every row under every candidate's weights, in one pass."""
    table = F.array(*(F.struct(F.lit(n).alias("candidate"), F.array(*map(F.lit, w)).alias("w")) for n, w in candidates.items()))
    each = rows.select(*features, F.col(truth).alias("truth"), F.explode(table).alias("__c"))
    return each.select("__c.candidate", weighted(features, F.col("__c.w")).alias("score"), "truth")


def subset_areas(rows: DataFrame, features: Sequence[str], subsets: dict[str, Sequence[str]], truth: str = "truth") -> DataFrame:
    """ROC area and average precision of the equal-weighted sum of each subset of features; all subsets share a pass."""
    candidates = {n: tuple((1 / len(s) if f in s else 0.0) for f in features) for n, s in subsets.items()}
    return areas(scored_by(rows, features, candidates, truth), "candidate").withColumnRenamed("candidate", "subset")


def _binned_areas(rows: DataFrame, features: Sequence[str], candidates: list[Weights], truth: str, bins: int) -> list[float]:
    """ROC areas of all candidates to the resolution of `bins` levels of the score, from one job: rows are counted by
    candidate, level and truth before they move, so what moves does not grow with them."""
    level = F.floor(F.col("score") * bins).alias("level")
    counts = scored_by(rows, features, {str(k): w for k, w in enumerate(candidates)}, truth).groupBy("candidate", level).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    held = counts.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct("level", "pos", "neg"))).alias("x"))  # at most one entry for each level
    zero = F.struct(F.lit(0).cast("long").alias("neg"), F.lit(0.0).alias("wins"))
    walked = F.aggregate("x", zero, lambda a, x: F.struct((a["neg"] + x["neg"]).alias("neg"), (a["wins"] + x["pos"] * (a["neg"] + x["neg"] / 2)).alias("wins")))
    total = lambda c: F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x[c])
    found = {r.candidate: r.auc for r in held.select("candidate", _over(walked["wins"], total("pos") * total("neg")).alias("auc")).collect()}  # one row for each candidate
    return [found.get(str(k), 0.0) for k in range(len(candidates))]


def optimise_weights(rows: DataFrame, features: Sequence[str], starts: Sequence[Weights] = (), truth: str = "truth", rounds: int = 6, step: float = 0.4, bins: int = 2048) -> dict[str, tuple[Weights, float]]:
    """Non-negative weights of sum one with a large ROC area, and the areas of equal weights and of each feature alone.

    A search over the simplex: each round moves a step of weight from each feature to each other, scores all these
    candidates in one pass, and goes to the best; a round that gains nothing halves the step. The exact areas of the point
    reached, of the starts, of the corners and of equal weights are then taken together and the best is returned, so it is
    never worse than any of these. Features should lie between 0 and 1; rows without truth or a feature are left out.
    """
    n = len(features)
    known = rows.dropna(subset=[*features, truth])
    corners = [tuple(float(i == j) for j in range(n)) for i in range(n)]
    given = [tuple(1 / n for _ in features), *map(tuple, starts), *corners]
    values = _binned_areas(known, features, given, truth, bins)
    best, at = max(zip(values, given), key=lambda x: x[0])
    for _ in range(rounds):
        moves = []
        for i in range(n):
            for j in range(n):
                if i != j and (shift := min(step, at[i])) > 0:
                    w = list(at)
                    w[i], w[j] = w[i] - shift, w[j] + shift
                    moves.append(tuple(round(x, 9) for x in w))
        value, move = max(zip(_binned_areas(known, features, moves, truth, bins), moves), key=lambda x: x[0])
        if value > best:
            best, at = value, move
        else:
            step /= 2
    names = {"found": at, "equal": given[0]} | {f"start{k}": tuple(w) for k, w in enumerate(starts)} | {f: corners[k] for k, f in enumerate(features)}
    exact = {r.candidate: r.auroc for r in areas(scored_by(known, features, names, truth), "candidate").collect()}  # one row for each name
    winner = max(names, key=lambda c: (exact.get(c, 0.0), c == "found"))
    return {"best": (names[winner], exact.get(winner, 0.0))} | {c: (w, exact.get(c, 0.0)) for c, w in names.items()}


def _cuts() -> np.ndarray:
    """Where the distribution of a Poisson count of mean one steps up: at or above the k-th the count is k or more."""
    out, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        out.append(total)
        p /= k
    return np.array(out)


def poisson_draws(ids: Sequence[str], replicates: int) -> np.ndarray:
    """(rows, replicates) weights: Poisson counts of mean one, each from four bytes of a SHA-256 of the id and the block of
    eight replicates."""
    blocks = -(-replicates // 8)
    data = b"".join([hashlib.sha256(f"{i}|{b}".encode()).digest() for i in ids for b in range(blocks)])
    u = np.frombuffer(data, ">u4").reshape(len(ids), blocks * 8)[:, :replicates] / 4294967296.0
    return np.searchsorted(_cuts(), u, side="right")


def resampled_means(rows: DataFrame, id_col: str, values: Sequence[str], replicates: int, *by: str) -> DataFrame:
    """(by, n, mean_<v>, draws_<v>): the mean of each value and its means in bootstrap replicates.

    All values of a row share its draws, so differences of methods are paired. A batch of rows becomes one line of sums
    for each group and replicate; rows are never multiplied. Rows where a value is null count for the others only.
    """
    keys = rows.select(*by).schema
    kinds = list(to_arrow_schema(keys))
    given = rows.select(*by, F.col(id_col).cast("string").alias("__id"), *(F.col(v).cast("double").alias(v) for v in values))
    names = [*by, "__value", "__k", "__s", "__n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            of: dict[tuple, int] = {}
            codes = np.fromiter((of.setdefault(k, len(of)) for k in (zip(*(c.to_pylist() for c in batch.columns[: len(by)])) if by else [()] * batch.num_rows)), np.int64, batch.num_rows)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            w = np.column_stack([np.ones(len(codes), np.int64), poisson_draws(table["__id"].to_pylist(), replicates)])[order]  # first the rows themselves
            out: list[tuple] = []
            for v in values:
                x = np.array([np.nan if a is None else a for a in table[v].to_pylist()], float)[order]
                there = ~np.isnan(x)
                sums = np.add.reduceat(w * np.where(there, x, 0.0)[:, None], starts)
                counts = np.add.reduceat(w * there[:, None], starts)
                for key, s, n in zip(of, sums, counts):
                    out += [(*key, v, k - 1, float(a), int(b)) for k, (a, b) in enumerate(zip(s, n))]
            types = [f.type for f in kinds] + [pa.string(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "__value string, __k int, __s double, __n bigint"])
    sums = given.mapInArrow(run, ddl).groupBy(*by, "__value", "__k").agg(F.sum("__s").alias("s"), F.sum("__n").alias("n"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    own = lambda v, c: F.when((F.col("__value") == v) & c, F.struct("__k", mean.alias("m")))
    found = sums.groupBy(*by).agg(
        *(F.max(F.when((F.col("__value") == v) & (F.col("__k") < 0), F.struct("n", mean.alias("m")))).alias(f"__all_{v}") for v in values),
        *(F.array_sort(F.collect_list(own(v, F.col("__k") >= 0))).alias(f"__d_{v}") for v in values),  # one for each replicate
    )
    return found.select(*by, F.col(f"__all_{values[0]}.n").alias("n"), *(F.col(f"__all_{v}.m").alias(f"mean_{v}") for v in values), *(F.transform(f"__d_{v}", lambda x: x["m"]).alias(f"draws_{v}") for v in values))


def interval(draws: Column, low: float = 0.025, high: float = 0.975) -> Column:
    """Elements of the sorted draws at the floor of n times each share."""
    held = F.array_sort(F.filter(draws, lambda x: x.isNotNull()))
    at = lambda p: F.try_element_at(held, F.least(F.floor(F.size(held) * F.lit(p)), F.size(held) - 1).cast("int") + 1)
    return F.struct(at(low).alias("low"), at(high).alias("high"))


def variance(draws: Column) -> Column:
    held = F.filter(draws, lambda x: x.isNotNull())
    n = F.size(held)
    mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


Model = Callable[[dict[str, Column]], Column]


def attributions(model: Model, values: dict[str, Column], baseline: dict[str, Column], seed: Column, samples: int = 16, exact_up_to: int = 6) -> Column:
    """array<struct<feature, value>>: Shapley attributions of a prediction, largest first by size.

    Up to `exact_up_to` features the model is evaluated on every coalition (those at their values, the rest at their
    baselines) and a feature gets its weighted gains over all of them. Beyond, `samples` orders of the features are drawn for
    each row from a hash of `seed`; along an order each feature is changed to its value and credited with what the
    prediction moves. Either way the attributions sum to the prediction minus that of the baseline.
    """
    names = list(values)
    n = len(names)
    if n <= exact_up_to:
        table = F.array(*(model({f: values[f] if code >> i & 1 else baseline[f] for i, f in enumerate(names)}) for code in range(1 << n)))

        def gains(v: Column) -> Column:
            out = []
            for i in range(n):
                each = [(code, factorial(k := code.bit_count()) * factorial(n - k - 1) / factorial(n)) for code in range(1 << n) if not code >> i & 1]
                out.append(reduce(Column.__add__, (w * (v[code | 1 << i] - v[code]) for code, w in each)))
            return F.array(*out)

        total = F.element_at(F.transform(F.array(table), gains), 1)  # the table is bound once
    else:

        def drawn(k: Column) -> Column:
            keys = [F.xxhash64(seed, k, F.lit(name)) for name in names]
            return F.array(*(reduce(Column.__add__, ((other < own).cast("int") for other in keys), F.lit(0)) for own in keys))

        def credits(place: Column) -> Column:
            steps = F.array(*(model({f: F.when(place[i] < p, values[f]).otherwise(baseline[f]) for i, f in enumerate(names)}) for p in range(n + 1)))
            return F.transform(F.array(steps), lambda s: F.transform(place, lambda r: F.get(s, r + 1) - F.get(s, r)))[0]

        ranks = F.transform(F.sequence(F.lit(1), F.lit(samples)), drawn)  # the place of each feature in each order
        total = F.aggregate(F.transform(ranks, credits), F.array(*[F.lit(0.0)] * n), lambda a, x: F.zip_with(a, x, lambda s, c: s + c), lambda a: F.transform(a, lambda s: s / samples))
    named = F.zip_with(F.array(*map(F.lit, names)), total, lambda f, v: F.struct(f.alias("feature"), v.alias("value")))
    by_size = lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1)
    return F.array_sort(named, by_size)
