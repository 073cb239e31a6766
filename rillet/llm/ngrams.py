"""Hashed character n-grams of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

#: Number of hash buckets.
BUCKETS = 1 << 16


def codes(text: str, lower: bool = True) -> np.ndarray:
    """Code points of a text; letters only when lower-cased, every other run as one space."""
    if lower:
        text = text.lower()
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(points: np.ndarray) -> np.ndarray:
    """Buckets of all 2- and 3-grams and single characters of one array of code points (int64)."""
    p = points.astype(np.uint64)
    if not p.size:
        return np.zeros(0, np.int64)
    one = p * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] >> np.uint64(7)) ^ (p[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    three = (two[:-1] * np.uint64(0x165667B19E3779F9)) ^ (p[2:] * np.uint64(0x27D4EB2F165667C5))
    grams = np.concatenate([one, two * np.uint64(0x2545F4914F6CDD1D), three * np.uint64(0x9FB21C651E98DF25)])
    return (grams >> np.uint64(48)).astype(np.int64)


def mean_scores(points: np.ndarray, weights: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Mean of ``weights[bucket]`` (buckets × k) over all n-grams of a text, in chunks of bounded memory."""
    total, n = np.zeros(weights.shape[1]), 0
    for at in range(0, max(points.size, 1), chunk):
        h = hashed(points[at: at + chunk + 2])
        total += weights[h].sum(axis=0, dtype=np.float64)
        n += h.size
    return total / max(n, 1)
