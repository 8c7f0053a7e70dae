"""Proof-of-computation summaries: recomputation, checks, bounds and scores as Column expressions.

A summary has scales array<int>, counts array<bigint> (boxes at each scale), D_hat, coh_star, r, budget, regime.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VerifyParams:
    """Default tolerances and budget weights."""

    tol_d: float = 0.15
    tol_coh: float = 0.05
    alpha: float = 0.30
    beta: float = 0.50
    gamma: float = 0.20
    base: float = 0.10
    d0: float = 2.2
    tol_budget: float = 0.01


def pcs_id(root: Column, epoch: Column, shard: Column) -> Column:
    return F.sha2(F.concat_ws("|", root, epoch.cast("string"), shard), 256)


def counts_of(scales: Column, n_j: Column) -> Column:
    """Counts in the order of scales from a map keyed by the scale's digits; null where one is missing."""
    return F.transform(scales, lambda s: F.element_at(n_j, s.cast("string")).cast("bigint"))


def slopes(scales: Column, counts: Column) -> Column:
    """Slopes of log2 counts over log2 scales of all pairs, sorted; null if a count is missing or not positive."""
    points = F.arrays_zip(F.transform(scales, lambda s: F.log2(s.cast("double"))).alias("x"), F.transform(counts, lambda c: F.when(c > 0, F.log2(c.cast("double")))).alias("y"))

    def pairs(p: Column) -> Column:
        def of(i: Column) -> Column:
            a = F.element_at(p, i)
            later = F.slice(p, i + 1, F.size(p) - i)
            return F.transform(F.filter(later, lambda b: F.abs(b["x"] - a["x"]) >= 1e-9), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))

        return F.when(F.size(p) >= 2, F.array_sort(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), of))))

    ok = F.forall(counts, lambda c: F.coalesce(c > 0, F.lit(False)))
    return F.when(ok, F.element_at(F.transform(F.array(points), pairs), 1))


def median(ordered: Column, how: str = "upper") -> Column:
    """Median of a sorted array: the upper middle, or the mean of both middles."""
    n = F.size(ordered)
    upper = F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    if how == "upper":
        return F.when(n > 0, upper)
    lower = F.element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1)
    return F.when(n > 0, (upper + lower) / 2)


def dhat(scales: Column, counts: Column, how: str = "upper") -> Column:
    """Theil-Sen dimension, to nine decimals."""
    return F.round(median(slopes(scales, counts), how), 9)


def regime(d: Column, coh: Column) -> Column:
    return F.when((coh >= 0.70) & (d <= 1.5), "sticky").when(d >= 2.6, "non_sticky").otherwise("mixed")


def budget(d: Column, coh: Column, r: Column, p: VerifyParams = VerifyParams()) -> Column:
    raw = p.base + p.alpha * (1 - r) + p.beta * F.greatest(F.lit(0.0), d - p.d0) + p.gamma * coh
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 9)


def verdict(p: VerifyParams = VerifyParams()) -> Column:
    """struct<accepted, escalated, recomputed_d, recomputed_budget, reason> of a row of summary columns; the first failing check decides."""
    d = F.col("recomputed_d")
    b = budget(F.col("D_hat"), F.col("coh_star"), F.col("r"), p)
    reason = (
        F.when((F.col("merkle_root") == "") | (F.size("scales") == 0) | (F.col("epoch") < 0), "validation failed")
        .when(d.isNull(), "D_hat recomputation failed")
        .when(F.abs(F.col("D_hat") - d) > p.tol_d, "D_hat out of tolerance")
        .when((F.col("coh_star") < 0) | (F.col("coh_star") > 1 + p.tol_coh), "coh_star out of bounds")
        .when(F.col("regime") != regime(F.col("D_hat"), F.col("coh_star")), "regime mismatch")
        .when(F.abs(F.col("budget") - b) > p.tol_budget, "budget deviation")
    )
    soft = reason.isin("regime mismatch", "budget deviation")
    return F.struct((reason.isNull() | soft).alias("accepted"), reason.isNotNull().alias("escalated"), d.alias("recomputed_d"), b.alias("recomputed_budget"), F.coalesce(reason, F.lit("")).alias("reason"))


def sanity(strict: bool = False) -> Column:
    """Name of the first failing plausibility check of a row of summary columns; null if all hold."""
    d, up = F.col("D_hat"), F.col("counts")
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(up) - 1, F.lit(1))), lambda i: F.coalesce(F.get(up, i) < F.get(up, i - 1), F.lit(False)))
    out = (
        F.when(F.exists(up, lambda c: c.isNull()) | falls, "counts")
        .when((F.size("scales") == 0) | F.exists("scales", lambda s: (s < 1) | (s > 1024)), "scales")
        .when((F.col("coh_star") < 0) | (F.col("coh_star") > 1.05), "coherence")
        .when((F.col("r") < 0) | (F.col("r") > 1), "compressibility")
        .when((d < 0) | (d > 3.5), "dimension")
    )
    if strict:
        out = out.when((d < 0.5) | (d > 3.0), "strict dimension")
    return out.when((F.col("budget") < 0) | (F.col("budget") > 1), "budget").when(~F.col("merkle_root").rlike("^[0-9a-fA-F]{64}$"), "merkle root")


def dimension_confidence(d: Column) -> Column:
    return F.when(d < 1.5, d / 1.5).when(d <= 2.5, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (d - 2.5)))


def sample_variance(values: Column) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (n - 1))


def compressibility_class(r: Column) -> Column:
    return F.when(r < 0.5, "repetitive").when(r > 0.8, "high entropy").otherwise("normal")


def ensemble_bound(confidences: list[Column], error_budget: float = 0.02) -> Column:
    """struct<lower, upper, meets>: Hoeffding's bound above a mean confidence of one half, else one less the product."""
    n = len(confidences)
    mean = sum(confidences[1:], confidences[0]) / n
    product = confidences[0]
    for c in confidences[1:]:
        product = product * c
    upper = F.when(mean > 0.5, F.exp(-2.0 * n * (mean - 0.5) * (mean - 0.5))).otherwise(1 - product)
    return F.struct((1 - upper).alias("lower"), upper.alias("upper"), (upper <= error_budget).alias("meets"))


def anomaly_score() -> Column:
    """Weighted sum of four suspicious traits, at most one."""
    d, coh, r = F.col("D_hat"), F.col("coh_star"), F.col("r")
    parts = (
        F.when(d < 0.5, (0.5 - d) / 0.5).when(d > 2.8, (d - 2.8) / 0.7).otherwise(0.0) * 0.3
        + F.when((coh > 0.8) & (d > 2.5), (coh - 0.8) * (d - 2.5)).otherwise(0.0) * 0.25
        + F.when(r < 0.1, (0.1 - r) / 0.1).when(r > 0.95, (r - 0.95) / 0.05).otherwise(0.0) * 0.2
        + F.when(F.col("regime") != regime(d, coh), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), parts)


#: Weights of the logistic risk model, and its intercept.
RISK_WEIGHTS = {"D_hat": 0.3, "coh_star": -0.5, "r": -0.4, "budget": -0.6, "signal_entropy": 0.2, "coherence_delta": 0.15, "compressibility_z": 0.1, "verify_latency_ms": 0.05}
RISK_INTERCEPT = -0.5


def signal_entropy(*signals: Column) -> Column:
    """Entropy, in nats, of the signals' shares of their sum."""
    total = sum(signals[1:], signals[0])
    parts = [F.when((s > 0) & (total > 0), -(s / total) * F.log(s / total)).otherwise(0.0) for s in signals]
    return sum(parts[1:], parts[0])


def risk(features: dict[str, Column], platt: tuple[float, float] | None = None) -> Column:
    z = F.lit(RISK_INTERCEPT)
    for name, weight in RISK_WEIGHTS.items():
        if name in features:
            z = z + weight * (features[name] / 1000.0 if name == "verify_latency_ms" else features[name])
    p = 1.0 / (1.0 + F.exp(-z))
    return 1.0 / (1.0 + F.exp(platt[0] * p + platt[1])) if platt else p


def risk_interval(p: Column) -> Column:
    half = 1.96 * 0.1 * F.sqrt(p * (1 - p))
    return F.struct(F.greatest(F.lit(0.0), p - half).alias("low"), F.least(F.lit(1.0), p + half).alias("high"))


def route(p: Column, width: Column, enabled: bool = True, below: float = 0.10, narrow: float = 0.05, need_narrow: bool = True) -> Column:
    """Reason of the route taken; only the last takes the fast path."""
    if not enabled:
        return F.lit("risk_routing_disabled")
    out = F.when(p >= below, "high_risk")
    if need_narrow:
        out = out.when(width >= narrow, "wide_confidence_interval")
    return out.otherwise("low_risk_narrow_ci")


def guardrail(score: Column, uncertainty: Column) -> Column:
    return F.when((score >= 0.9) & (uncertainty <= 0.2), "block").when(score >= 0.5, "guardrail").otherwise("pass")


def learning_priority(score: Column, uncertainty: Column) -> Column:
    return uncertainty + F.when(F.abs(score - 0.9) < 0.1, 0.5).otherwise(0.0)
