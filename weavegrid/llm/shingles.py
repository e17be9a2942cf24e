"""Word shingles and minwise hashes over batches of texts, in NumPy.

Words are maximal runs without white space, taken as they stand. A text of one
to four words has one shingle, all of them; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles."""
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        if 0 < len(w) < k:
            w += [""] * (k - len(w))  # words are never empty, so this can't clash
        words += w
        ends[i + 1] = len(words)
    if not words:
        return [np.zeros(0, np.uint64) for _ in texts]
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = len(h) - k + 1
    s = h[:n].copy()
    for j in range(1, k):
        s = s * _STEP + h[j : j + n]
        s ^= s >> np.uint64(29)
    s = mix(s)
    return [np.unique(s[a : b - k + 1]) if b > a else np.zeros(0, np.uint64) for a, b in zip(ends[:-1], ends[1:])]


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of each multiply-add hash over a set; 0 if it is empty."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 2048):
        part = s[i : i + 2048, None] * a[None, :]
        part += b[None, :]
        np.minimum(out, (part >> np.uint64(32)).min(axis=0), out=out)
    return (out if len(s) else out * np.uint64(0)).astype(np.uint32)
