"""Compressed lists of integers, dealt to buckets by hash."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard


@contextmanager
def uncollected() -> Iterator[None]:
    """Pause the cyclic collector, whose passes over large dictionaries cost more than the work on them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T if len(x) else np.zeros((x.itemsize, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts of any size: 32-bit where all fit, else 64-bit; the first byte says which."""
    kind = np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + pack(x.astype(kind))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], np.uint32 if data[0] == 4 else np.uint64).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finish of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, keeping the given order within, and where each bucket begins."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def ordered(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes. Their high bits are sorted with each one's place in the low bits, which is far
    cheaper than an argsort; the few runs whose high bits tie are then put in order, and all anew if they are many."""
    n = len(keys)
    mask = np.uint64((1 << max(n - 1, 1).bit_length()) - 1)
    order = (np.sort((keys & ~mask) | np.arange(n, dtype=np.uint64)) & mask).astype(np.int64)
    k = keys[order]
    wrong = np.flatnonzero(k[1:] < k[:-1])
    if len(wrong) > 64:
        return np.argsort(keys, kind="stable")
    high = k & ~mask
    for at in wrong:
        lo, hi = np.searchsorted(high, high[at]), np.searchsorted(high, high[at], side="right")
        order[lo:hi] = order[lo:hi][np.argsort(k[lo:hi], kind="stable")]
    return order


def ranged(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and where each of so many equal ranges of hashes begins. For hashes that are evenly spread."""
    order = np.arange(len(hashes)) if (hashes[1:] >= hashes[:-1]).all() else ordered(hashes)
    bounds = np.array([min((k << 64) // buckets, (1 << 64) - 1) for k in range(buckets)], dtype=np.uint64)
    return order, np.append(np.searchsorted(hashes[order], bounds), len(hashes))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, the place of each one's first holder, and every key's number among them."""
    order = ordered(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.empty(len(s), np.int64)
    at[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return s[starts], np.minimum.reduceat(order, starts) if len(starts) else starts, at
