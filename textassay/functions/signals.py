"""Signals that no built-in function computes: compression ratios, projections, quantisation and keyed digests.

Each is an Arrow-batched function of one row, applied after columns are pruned and never inside a join.
"""

from __future__ import annotations

import hashlib
import hmac
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(DoubleType())
def zlib_ratio(text: pd.Series) -> pd.Series:
    """Compressed over plain bytes at level 6, at most one; one for an empty text."""
    raw = text.fillna("").str.encode("utf-8")
    return raw.map(lambda b: round(min(1.0, len(zlib.compress(b, 6)) / len(b)), 9) if b else 1.0)


def directions(n: int, dim: int, seed: int = 0) -> np.ndarray:
    """n unit vectors of a fixed pseudo-random normal sample."""
    v = np.random.default_rng(seed).standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def coherence(points: np.ndarray, n_directions: int = 100, bins: int = 20, seed: int = 0) -> tuple[float, np.ndarray]:
    """Largest histogram share of the points' projections on any direction, and that direction. Equal projections share one bin."""
    if len(points) == 0:
        return 0.0, np.zeros(points.shape[1] if points.ndim == 2 else 0)
    v = directions(n_directions, points.shape[1], seed)
    p = points @ v.T
    low, width = p.min(axis=0), np.ptp(p, axis=0)
    width[width == 0] = 1.0
    at = np.minimum((p - low) / width * bins, bins - 1).astype(int)
    counts = np.stack([np.bincount(at[:, k], minlength=bins).max() for k in range(n_directions)])
    best = int(counts.argmax())
    return round(float(counts[best]) / len(points), 9), v[best]


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(centres)):
            if (at == j).any():
                centres[j] = x[at == j].mean(axis=0)
    return centres


def quantised_ratio(points: np.ndarray, parts: int = 8, k: int = 16) -> float:
    """Compressed size of product-quantisation codes over their plain size, at most one."""
    if len(points) == 0:
        return 1.0
    codes = []
    for x in np.array_split(points, parts, axis=1):
        c = k_means(x, k)
        codes.append(((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1).astype(np.uint8))
    raw = np.stack(codes, axis=1).tobytes()
    return round(min(1.0, len(zlib.compress(raw, 6)) / len(raw)), 9)


def pca_dimension(points: np.ndarray, share: float = 0.95) -> int:
    """Principal components that explain share of the variance."""
    if len(points) < 2:
        return len(points)
    s = np.linalg.svd(points - points.mean(axis=0), compute_uv=False) ** 2
    return int(np.searchsorted(np.cumsum(s) / s.sum(), share) + 1) if s.sum() else 1


def hmac_sign(payload: Column, key: bytes) -> Column:
    """HMAC-SHA256, in hexadecimal, over the payload's SHA-256 digest."""

    @pandas_udf(StringType())
    def sign(p: pd.Series) -> pd.Series:
        return p.map(lambda x: hmac.new(key, hashlib.sha256((x or "").encode()).digest(), hashlib.sha256).hexdigest())

    return sign(payload)


def hmac_verify(payload: Column, key: bytes, signature: Column) -> Column:
    return F.coalesce(hmac_sign(payload, key) == signature, F.lit(False))


@pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    from math import erfc, sqrt

    return x.map(lambda v: erfc(sqrt(v / 2)) if v is not None and v >= 0 else None)
