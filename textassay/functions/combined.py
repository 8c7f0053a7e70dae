"""Perplexity normalisers and the named combinations of dimension, coherence, compressibility and perplexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of (1 - D / 3.5, |coh - 0.7|, 1 - r, log perplexity) by task.
TASK_WEIGHTS = {"balanced": (0.25, 0.25, 0.25, 0.25), "factuality": (0.15, 0.10, 0.10, 0.65), "degeneracy": (0.15, 0.15, 0.60, 0.10)}


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def normalised_perplexity(p: Column, how: str = "log") -> Column:
    """0 to 1, higher for the less likely: by logarithm up to 100, by inverse, or clipped to 1..20."""
    if how == "log":
        return clipped(F.log(p) / F.log(F.lit(100.0)))
    if how == "inv":
        return 1 - 1 / p
    return (clipped(p, 1.0, 20.0) - 1) / 19


def suspicion(d: Column, coh: Column, r: Column, p: Column, task: str = "balanced") -> Column:
    """Weighted signals, higher for the more suspect; coherence counts by its distance from 0.7."""
    a, b, c, e = TASK_WEIGHTS[task]
    return a * (1 - clipped(d / 3.5)) + b * F.abs(coh - 0.7) + c * (1 - r) + e * normalised_perplexity(p)


def calibrated_anomaly(d: Column, coh: Column, r: Column, tol: float = 0.05) -> Column:
    """Low dimension, low coherence, and compressibility away from 0.65 either way."""
    odd = F.least(F.lit(1.0), F.abs(clipped(r) - 0.65) / 0.65)
    return 0.35 * (1 - clipped(d / 3.5)) + 0.40 * (1 - clipped(coh / (1 + tol))) + 0.25 * odd


def nonconformity(d: Column, coh: Column, r: Column) -> Column:
    return 0.4 * (2.5 - d) / 2.5 + 0.3 * (1 - coh) + 0.3 * (1 - r)


def hallucination(d: Column, coh: Column, r: Column) -> Column:
    return 0.5 * (1 - clipped(d / 3.0)) + 0.3 * (1 - coh) + 0.2 * (1 - r)


def _plateau(x: Column, low: float, high: float, over: float) -> Column:
    """1 between low and high, falling to 0 at zero and at high + over."""
    return F.when(x < low, F.greatest(F.lit(0.0), x / low)).when(x <= high, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (x - high) / over))


def normality(d: Column, coh: Column, r: Column) -> Column:
    """Higher for signals in their usual ranges."""
    return clipped(0.35 * _plateau(d, 1.5, 2.5, 0.5) + 0.25 * _plateau(coh, 0.3, 0.6, 0.4) + 0.40 * _plateau(r, 0.4, 0.7, 0.3))
