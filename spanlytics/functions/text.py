"""Text columns: offset-preserving normalisation, sentence bounds, entities, hashes, flags.

Spark has no Unicode normalisation and no index maps, so those two are Arrow UDFs over whole
batches; everything else is a built-in expression.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from spanlytics.functions.core import col, let
from spanlytics.functions.tokens import in_slices, int_lists, token_bounds

# Well-formed inline markup, zero-width characters, line breaks.
TAG = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,200})?/?>"
ZERO_WIDTH = "​‌‍﻿⁠­"
LINE_BREAKS = "\r\n\x0b\x0c\x1c\x1d\x1e\x85  "
# Characters unified before matching.
UNIFIED = {
    "‘": "'",
    "’": "'",
    "‚": "'",
    "‛": "'",
    "“": '"',
    "”": '"',
    "„": '"',
    "–": "-",
    "—": "-",
    "−": "-",
    " ": " ",
    "…": "...",
}
# Characters trimmed from the two ends of a span before a second attempt.
LEADING = r"^[\s\"'“”‘’(\[\-–—.,;:]+"
TRAILING = r"[\s\"'“”‘’)\]\-–—]+$"

# A text of ``size`` characters with its index map in run-length form: from place ``at`` on, the source
# position is ``source`` plus the distance from ``at``. A text that nothing changes needs one run.
MAPPED = StructType(
    [
        StructField("text", StringType()),
        StructField("size", IntegerType()),
        StructField("at", ArrayType(IntegerType())),
        StructField("source", ArrayType(IntegerType())),
    ]
)
BOUNDS = StructType([StructField("s", ArrayType(IntegerType())), StructField("e", ArrayType(IntegerType()))])
RANGED = StructType([StructField(n, ArrayType(IntegerType())) for n in ("s", "e", "ts", "tj")])

_TAG = re.compile(TAG)
#: Characters that are normalised together; a longer text is a block of its own.
BLOCK_CHARS = 1 << 18


class _Becomes:
    """What each code point turns into; asked once for every code point that is met."""

    def __init__(self, change):
        self.change = change
        self.size = np.full(0x110000, 255, np.uint8)
        self.first = np.zeros(0x110000, np.uint32)
        self.more: dict[int, np.ndarray] = {}

    def apply(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New code points, and for each the place of its origin in ``codes``."""
        for code in np.unique(codes[self.size[codes] == 255]).tolist():
            out = np.array([ord(c) for c in self.change(chr(code))], np.uint32)
            self.size[code], self.first[code] = len(out), out[0] if len(out) else 0
            if len(out) > 1:
                self.more[code] = out
        n = self.size[codes]
        if (n == 1).all():
            return self.first[codes], np.arange(len(codes))
        origin = np.repeat(np.arange(len(codes)), n)
        new = self.first[codes][origin]
        starts = np.cumsum(n, dtype=np.int64) - n
        for code in np.unique(codes[n > 1]).tolist():
            long = self.more[code]
            new[starts[codes == code][:, None] + np.arange(len(long))] = long
        return new, origin


# 1 for white space, 2 for a line break; no code point above U+3000 is white space
_BLANK = np.zeros(0x110000, np.uint8)
for _c in map(chr, range(0x3001)):
    if _c.isspace():
        _BLANK[ord(_c)] = 2 if _c in LINE_BREAKS else 1

_NORMAL = _Becomes(lambda c: "" if c in ZERO_WIDTH else unicodedata.normalize("NFKC", c))
_MATCHING = _Becomes(lambda c: "".join(x.lower() for x in unicodedata.normalize("NFKC", UNIFIED.get(c, c))))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _squeezed(codes, row, source, keep_breaks: bool):
    """Every run of white space becomes one character; those at the ends of a row go."""
    blank = _BLANK[codes]
    solid = np.flatnonzero(blank == 0)
    if len(solid) == len(codes):
        return codes, row, source
    same = row[solid][1:] == row[solid][:-1]
    gap = np.concatenate([[False], (np.diff(solid) > 1) & same])[: len(solid)]
    ends = np.cumsum(1 + gap) - 1
    out = [np.empty(int(ends[-1]) + 1 if len(ends) else 0, x.dtype) for x in (codes, row, source)]
    for new, old in zip(out, (codes, row, source)):
        new[ends] = old[solid]
    first = solid[np.flatnonzero(gap) - 1] + 1  # of each run that stays
    breaks = np.concatenate([[0], np.cumsum(blank == 2)])
    broken = breaks[solid[gap]] > breaks[first]
    out[0][ends[gap] - 1] = np.where(broken & keep_breaks, ord("\n"), ord(" "))
    out[1][ends[gap] - 1], out[2][ends[gap] - 1] = row[first], source[first]
    return tuple(out)


def _mapped(texts: list[str], table: _Becomes, tags: bool, keep_breaks: bool) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Changed text and runs of the index map of every text."""
    parts = [_codes(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    codes, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
    source = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if tags:
        spans = [(o + m.start(), o + m.end()) for o, t in zip((np.cumsum(sizes) - sizes).tolist(), texts) if "<" in t for m in _TAG.finditer(t)]
        if spans:
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, [a for a, _ in spans], 1)
            np.add.at(edge, [b for _, b in spans], -1)
            shown = np.cumsum(edge[:-1]) == 0
            codes, row, source = codes[shown], row[shown], source[shown]
    codes, origin = table.apply(codes)
    codes, row, source = _squeezed(codes, row[origin], source[origin], keep_breaks)
    begins = np.searchsorted(row, np.arange(len(texts) + 1))
    turn = np.ones(len(codes), bool)
    turn[1:] = (np.diff(source) != 1) | (np.diff(row) != 0)
    at = np.flatnonzero(turn)
    runs = np.searchsorted(at, begins)
    out = []
    for k in range(len(texts)):
        a, b, own = begins[k], begins[k + 1], at[runs[k] : runs[k + 1]]
        out.append((codes[a:b].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), own - a, source[own]))
    return out


def _blocks(texts: list[str]):
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def normalize_with_map(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """NFKC, no zero-width characters, no tags, squeezed whitespace; with the runs of the source index map."""
    return _mapped([text], _NORMAL, tags=True, keep_breaks=True)[0]


def match_forms(texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Lower-cased forms used for matching, with the runs of the source index map."""
    return [x for block in _blocks(texts) for x in _mapped(block, _MATCHING, tags=False, keep_breaks=False)]


def _mapped_rows(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int32()), int_lists([r[1] for r in rows]), int_lists([r[2] for r in rows])],
        fields=[pa.field("text", pa.string()), pa.field("size", pa.int32()), pa.field("at", pa.list_(pa.int32())), pa.field("source", pa.list_(pa.int32()))],
    )


def _normal_rows(text: pa.Array) -> pa.Array:
    blocks = _blocks([t or "" for t in text.to_pylist()])
    return _mapped_rows([x for block in blocks for x in _mapped(block, _NORMAL, tags=True, keep_breaks=True)])


def _matching_rows(text: pa.Array) -> pa.Array:
    return _mapped_rows(match_forms([t or "" for t in text.to_pylist()]))


@F.arrow_udf(MAPPED)
def normalized(text: pa.Array) -> pa.Array:
    """``struct<text, size, at, source>``: cleaned text and where its runs come from."""
    return in_slices(_normal_rows, text)


@F.arrow_udf(MAPPED)
def match_normalized(text: pa.Array) -> pa.Array:
    """``struct<text, size, at, source>`` of the lower-cased matching form."""
    return in_slices(_matching_rows, text)


def _form_lists(texts: pa.Array) -> pa.Array:
    forms = iter(match_forms([t or "" for t in texts.flatten().to_pylist()]))
    return pa.array([None if r is None else [next(forms)[0] for _ in r] for r in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def match_form_lists(texts: pa.Array) -> pa.Array:
    """Matching forms of ``array<string>`` columns, without maps."""
    return in_slices(_form_lists, texts)


def clean_text(text) -> Column:
    """Built-in variant without NFKC and index map, for bulk cleaning."""
    bare = F.regexp_replace(F.regexp_replace(col(text), TAG, ""), f"[{ZERO_WIDTH}]", "")
    lines = F.regexp_replace(bare, r"(?U)\s*[\r\n\x0B\f\x1c-\x1e\x85  ]\s*", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?U)[^\S\n]+", " "), r"(?U)^\s+|\s+$", "")


def count_below(values, limit, inclusive: bool = False) -> Column:
    """How many entries of a sorted array lie below ``limit`` (or at it), by binary search."""

    def halved(values, limit):
        def step(s, _):
            middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            value = F.get(values, middle)
            below = value <= limit if inclusive else value < limit
            return (
                F.when(s["lo"] >= s["hi"], s)
                .when(below, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))
                .otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))
            )

        steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(values) + F.lit(1))).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), step, lambda s: s["lo"])

    return let(F.struct(col(values).alias("v"), col(limit).cast("int").alias("x")), lambda s: halved(s["v"], s["x"]))


def to_source(mapped, start, end) -> Column:
    """Map a span of the normalised text back to the source (clamped to the map)."""
    m, start, end = col(mapped), col(start).cast("int"), col(end).cast("int")
    last = m["size"] - 1

    def at(place):
        place = F.least(F.greatest(place, F.lit(0)), last)
        return let(place, lambda p: let(count_below(m["at"], p, inclusive=True) - 1, lambda k: F.get(m["source"], k) + p - F.get(m["at"], k)))

    left = at(start)
    mapped_span = F.struct(left.alias("start"), F.when(end > start, at(end - 1) + 1).otherwise(left).alias("end"))
    return F.when(last >= 0, mapped_span).otherwise(F.struct(start.alias("start"), end.alias("end")))


def place_in(mapped, position) -> Column:
    """The first place of the normalised text whose source is at or behind ``position``."""
    m = col(mapped)

    def counted(x):
        def within(k):
            next_at = F.coalesce(F.get(m["at"], k), m["size"])
            return F.when(k == 0, F.lit(0)).otherwise(F.least(next_at, F.get(m["at"], k - 1) + x - F.get(m["source"], k - 1)))

        return let(count_below(m["source"], x), within)

    return let(col(position).cast("int"), counted)


def from_source(mapped, start, end) -> Column:
    """Map a source span into the normalised text."""
    ps = place_in(mapped, start)
    return let(F.struct(ps.alias("s"), place_in(mapped, end).alias("e")), lambda p: F.struct(p["s"].alias("start"), F.greatest(p["s"], p["e"]).alias("end")))


# A boundary follows terminal punctuation with optional closers when the next sentence starts with a
# capital, digit or opening mark; or is a run of line breaks that is not a soft wrap, i.e. a wrap
# after a non-terminal character and before a lower-case letter.
_BOUNDARY = regex.compile(
    r"""(?<=[.!?])["'”’)\]]*\s+(?=[A-Z0-9"'“(\[])|\n+(?!(?<=[^\s.!?:;"'”’)\]]\s*)\p{Lowercase})"""
)
_CLOSERS = regex.compile(r"""["'”’)\]]*""")


def sentence_bounds(text: str) -> tuple[list[int], list[int]]:
    """Trimmed ``[start, end)`` offsets of the sentences of one text."""
    cuts = [0]
    for m in _BOUNDARY.finditer(text):
        cuts += [_CLOSERS.match(text, m.start()).end(), m.end()]
    cuts.append(len(text))
    starts, ends = [], []
    for a, b in zip(cuts[::2], cuts[1::2]):
        piece = text[a:b]
        body = piece.strip()
        if body:
            lead = len(piece) - len(piece.lstrip())
            starts.append(a + lead)
            ends.append(a + lead + len(body))
    return starts, ends


def _sentence_rows(text: pa.Array) -> pa.Array:
    rows = [sentence_bounds(t or "") for t in text.to_pylist()]
    return pa.StructArray.from_arrays(
        [int_lists([np.asarray(r[i], dtype=np.int32) for r in rows]) for i in (0, 1)],
        fields=[pa.field("s", pa.list_(pa.int32())), pa.field("e", pa.list_(pa.int32()))],
    )


@F.arrow_udf(BOUNDS)
def sentence_offsets(text: pa.Array) -> pa.Array:
    return in_slices(_sentence_rows, text)


def _ranged_rows(text: pa.Array) -> pa.Array:
    rows = []
    for t in text.to_pylist():
        s, e = (np.asarray(x, dtype=np.int32) for x in sentence_bounds(t or ""))
        starts, ends = token_bounds(t or "")
        ts, tj, gap = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, e), np.searchsorted(starts, s)
        some = tj > ts
        rows.append((s, e, np.where(some, ts, gap), np.where(some, tj, gap)))
    names = [f.name for f in RANGED.fields]
    return pa.StructArray.from_arrays([int_lists([r[i] for r in rows]) for i in range(4)], fields=[pa.field(n, pa.list_(pa.int32())) for n in names])


@F.arrow_udf(RANGED)
def sentence_ranges(text: pa.Array) -> pa.Array:
    """Sentences of each text in characters (``s``, ``e``) and in tokens (``ts``, ``tj``)."""
    return in_slices(_ranged_rows, text)


_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.arrow_udf(StringType())
def decode_references(text: pa.Array) -> pa.Array:
    """Decode named and numeric character references that end with a semicolon; trim the result."""
    return pa.array(
        [None if t is None else _REFERENCE.sub(lambda m: html.unescape(m.group()), t).strip() for t in text.to_pylist()],
        pa.string(),
    )


@F.arrow_udf(ArrayType(StringType()))
def decode_reference_lists(texts: pa.Array) -> pa.Array:
    """``decode_references`` over ``array<string>`` columns."""
    return in_slices(_decoded_lists, texts)


def _decoded_lists(texts: pa.Array) -> pa.Array:
    flat = texts.flatten()
    decoded = [t if t is None or "&" not in t else _REFERENCE.sub(lambda m: html.unescape(m.group()), t).strip() for t in flat.to_pylist()]
    sizes = np.array([n or 0 for n in pc.list_value_length(texts).to_pylist()], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(decoded, pa.string()))


def decode_xml_entities(text) -> Column:
    """Built-in variant for the five XML entities."""
    out = col(text)
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return F.trim(out)


def strip_edges(text) -> Column:
    """Trim quotes, brackets and dashes from both ends; a trailing period or comma stays."""
    return F.regexp_replace(F.regexp_replace(col(text), LEADING, ""), TRAILING, "")


def shorten(text, limit: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))).otherwise(flat)


def sha256_text(text) -> Column:
    return F.sha2(col(text), 256)


def sha256_json(**fields) -> Column:
    """Hash of a JSON object with its keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*[col(fields[k]).alias(k) for k in sorted(fields)])), 256)


# Patterns that mark numbered items, reviewer headers and review rounds.
NUMBERED_ITEM = r"(?m)^\s*(?:\d+[.)]|[-*•])\s+"
REVIEWER_HEADER = r"(?i)reviewer\s*#?\s*\d"
ROUND_MARKER = r"(?i)\b(round\s*\d|revised (?:version|manuscript)|resubmission|essential revisions)\b"


def structure_flags(text) -> dict[str, Column]:
    return {
        "numbered_item": F.regexp_like(col(text), F.lit(NUMBERED_ITEM)),
        "reviewer_header": F.regexp_like(col(text), F.lit(REVIEWER_HEADER)),
        "round_marker": F.regexp_like(col(text), F.lit(ROUND_MARKER)),
    }
