"""Winnowed character fingerprints: two texts that share a long enough piece share a fingerprint.

With q-grams of ``Q`` characters and windows of ``W`` of them, every common substring of at least
``Q + W - 1`` characters leaves at least one equal fingerprint in both texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

Q = 12
W = 12


def _grams(text: str, q: int) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(cp) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            value = value * np.uint64(0x100000001B3) + cp[i : i + n]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def fingerprints(text: str, q: int = Q, w: int = W) -> np.ndarray:
    """Distinct window minima of the q-gram hashes."""
    grams = _grams(text, q)
    if not len(grams):
        return np.empty(0, np.int64)
    n = max(1, len(grams) - w + 1)
    low = grams[:n].copy()
    for i in range(1, min(w, len(grams))):
        np.minimum(low, grams[i : i + n], out=low)
    return np.unique(low).astype(np.int64)


def fingerprint_udf(q: int = Q, w: int = W):
    @F.arrow_udf(ArrayType(LongType()))
    def run(text: pa.Array) -> pa.Array:
        parts = [fingerprints(t or "", q, w) for t in text.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        values = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return run
