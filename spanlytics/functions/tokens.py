"""Regex tokens with code-point offsets, and interval arithmetic on token ranges.

A token is a run of word characters, where a single hyphen or apostrophe between two word
characters stays inside the run, or any other single non-space character.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from spanlytics.functions.core import col

# The token pattern as a Java / RE2 expression, and its word joiners.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:[-'’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"
JOINERS = "-'’"
#: Rows of a batch whose texts are Python objects at the same time.
SLICE = 256

OFFSETS = StructType([StructField("s", ArrayType(IntegerType())), StructField("e", ArrayType(IntegerType()))])


@lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    """Per code point: 0 other, 1 word, 2 space."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalnum() or ch == "_":
            table[cp] = 1
        elif ch.isspace():
            table[cp] = 2
    return table


def token_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all tokens of one text, vectorised over its code points."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(cp):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    kind = _char_classes()[cp]
    word = kind == 1
    inner = word.copy()
    if len(cp) > 2:
        joiner = np.isin(cp[1:-1], [ord(c) for c in JOINERS])
        inner[1:-1] |= joiner & word[:-2] & word[2:]
    glued = np.zeros(len(cp) + 1, dtype=bool)  # True between two characters of one token
    glued[1:-1] = inner[:-1] & inner[1:]
    solid = kind != 2
    starts = np.flatnonzero(solid & ~glued[:-1])
    ends = np.flatnonzero(solid & ~glued[1:]) + 1
    return starts.astype(np.int32), ends.astype(np.int32)


def int_lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def offsets_of(bounds_of):
    """The Arrow form of a function from a text to the starts and ends of its parts."""

    def run(text: pa.Array) -> pa.Array:
        bounds = [bounds_of(t or "") for t in text.to_pylist()]
        return pa.StructArray.from_arrays(
            [int_lists([b[0] for b in bounds]), int_lists([b[1] for b in bounds])],
            fields=[pa.field("s", pa.list_(pa.int32())), pa.field("e", pa.list_(pa.int32()))],
        )

    return run


def in_slices(run, text: pa.Array, rows: int = SLICE) -> pa.Array:
    """``run`` over a few rows at a time, so that the Python objects of a whole batch never stand in memory together."""
    return pa.concat_arrays([run(text.slice(at, rows)) for at in range(0, max(len(text), 1), rows)])


@F.arrow_udf(OFFSETS)
def token_offsets(text: pa.Array) -> pa.Array:
    """``struct<s: array<int>, e: array<int>>`` with one entry per token, in text order."""
    return in_slices(offsets_of(token_bounds), text)


def token_count(text) -> Column:
    return F.regexp_count(col(text), F.lit(TOKEN_PATTERN))


def overlap(a_start, a_end, b_start, b_end) -> Column:
    """Number of shared tokens of two token ranges."""
    return F.greatest(F.lit(0), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)))


def token_iou(a_start, a_end, b_start, b_end) -> Column:
    """Shared tokens over the union; 0 when either range is empty."""
    inter = overlap(a_start, a_end, b_start, b_end)
    union = (col(a_end) - col(a_start)) + (col(b_end) - col(b_start)) - inter
    empty = (col(a_end) <= col(a_start)) | (col(b_end) <= col(b_start))
    return F.when(empty, F.lit(0.0)).otherwise(F.try_divide(inter.cast("double"), union.cast("double")))


def token_set(start, end) -> Column:
    """Token indices of a range as an array; empty for an empty range."""
    return F.when(col(end) > col(start), F.sequence(col(start), col(end) - 1)).otherwise(
        F.array().cast("array<int>")
    )
