"""Substring dedup over sliding runs of pieces.

A text is cut into pieces at the ends of sentences and before words whose hash is the smallest of any
``WINDOW`` neighbouring words. From every piece the shortest run of pieces with at least ``MIN_WORDS``
words starts, and to every piece such a run ends. Cuts depend on the words nearby only, so wherever a
repeated passage starts or ends: its first window has a cut at word WINDOW - 1 at the latest, the run
from there ends within MIN_WORDS + WINDOW - 1 words, and all cuts up to WINDOW words before the end of
the passage are its own. A passage of MIN_WORDS + 3 * WINDOW - 2 = 50 words that is repeated with its
punctuation and line breaks thus always holds a common run. Runs are compared by a 128-bit hash of their
lower-case words over the whole corpus. The first place of a run (smallest document id, then place in
the text) stays; a piece that any later place covers is removed.

Nearly all runs stand in one place only. A first pass counts a 64-bit key of each run; the keys that
come more than once mark two places each in a bit map of a fixed size, which every task gets. A second
pass sends only the runs whose places are both marked. A run that is marked by chance costs a row and
changes nothing, since what is sent is compared by its whole hash.

Counts and first places combine before the shuffle, so a passage that very many documents share is no
hot key there; the join that brings the first places back is left to adaptive skew splitting. Only runs
that repeat come back, merged to ranges of pieces for each document.

Defined results: a null text stays null and an empty one empty; a document is its id and its text, so
rows equal in both are cut alike and an id that stands on several texts (or a null id) cuts each of them
by itself; a null id sorts last, and of one id's texts the order is that of their hashes; texts of any
length are whole; an empty table stays empty; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlytics.llm.common import BROADCAST_BYTES, fresh, query, read, released, written

MIN_WORDS = 25
WINDOW = 9
_END = re.compile(r"[.!?]+[ \t]+|\n+")
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\f\v"))
_STOP = np.isin(np.arange(256), list(b".!?"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of the map of repeated keys (16 MB), whatever the size of the corpus.
MAP_BITS = 1 << 27
_BLOCK = 1 << 15  # bits of one of Spark's bit maps
_RUNS = "doc long, th long, first int, last int, again boolean, h1 long, h2 long"


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word in lower case."""
    size = ends - starts
    at = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), _BASE))
        first = np.cumsum(size) - size
        h = np.add.reduceat((_LOWER[raw[at]] + np.uint64(1)) * powers[at - np.repeat(starts, size)], first)
        for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def _closed(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the matches of ``_END`` end: spaces behind a word with a closing mark, and line breaks."""
    gap = (raw == 32) | (raw == 9)
    stop = ends[(ends < len(raw)) & _STOP[raw[ends - 1]]]
    solid = np.append(np.flatnonzero(~gap), len(raw))
    spaces = solid[np.searchsorted(solid, stop[gap[stop]])]
    line = np.flatnonzero(raw == 10)
    return np.sort(np.concatenate([spaces, line[np.diff(line, append=len(raw) + 1) != 1] + 1]))


def _cuts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of a text that is not empty start, with its end, where its words start, and the hashes of these."""
    raw = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], ~_BLANK[raw], [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    closed = _closed(raw, ends)
    chosen = np.zeros(len(starts), bool)
    hashes = _hashes(raw, starts, ends) if len(starts) else np.empty(0, np.uint64)
    if len(starts) >= WINDOW:
        near = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
        chosen[np.arange(len(near)) + WINDOW - 1 - near[:, ::-1].argmin(axis=1)] = True
        # no second cut where a sentence ends between two words, none before the first word
        chosen[1:] &= np.searchsorted(closed, starts[1:], side="right") == np.searchsorted(closed, ends[:-1], side="right")
        chosen[0] = False
    return np.unique(np.concatenate([[0], closed, starts[chosen], [len(text)]])), starts, hashes


def sentences_of(text: str | None) -> list[str]:
    """Pieces of the text, each with what separates it from the next; joined they give the text."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    cuts = _cuts(raw)[0].tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(cuts, cuts[1:])]


class _Powers:
    """Powers of a base, made once and lengthened as texts ask for more."""

    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = max(n, 2 * len(self.values))
            self.values = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base)]))
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_UNDO)


def _places(raw: bytes, min_words: int):
    """First and last pieces of the runs of a text in order, the words before every cut, and a 64-bit key of every run."""
    cuts, words, hashes = _cuts(raw)
    upto = np.searchsorted(words, cuts)  # words before each cut
    n = len(cuts) - 1
    none = np.empty(0, np.int64)
    if upto[-1] < min_words:
        return none, none, upto, np.empty(0, np.uint64)
    starts = np.arange(n)
    last = np.searchsorted(upto, upto[:-1] + min_words) - 1  # shortest run from each start
    first = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1  # shortest run to each end
    forth, back = last < n, first >= 0
    span = np.unique(np.concatenate([starts[forth] * n + last[forth], first[back] * n + starts[back]]))
    a, b = span // n, span % n
    held = np.diff(upto) > 0
    both = held[a] & held[b]
    a, b = a[both], b[both]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _UP.upto(len(hashes)))])
    key = (sums[upto[b + 1]] - sums[upto[a]]) * _DOWN.upto(len(hashes) + 1)[upto[a]]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return a, b, upto, key ^ (key >> np.uint64(29))


def _hashed(raw: bytes, a: np.ndarray, b: np.ndarray, upto: np.ndarray) -> list[int]:
    """The hash of the lower-case words of each run."""
    lower = raw.lower().split()
    place = np.cumsum([0, *(len(w) + 1 for w in lower)])[upto]  # of each cut among the joined words
    joined = b" ".join(lower)
    return [xxhash.xxh3_128_intdigest(joined[x : y - 1]) for x, y in zip(place[a].tolist(), place[b + 1].tolist())]


def runs_of(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """``first, last, hash`` of the runs of a text; pieces are numbered from 0."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    a, b, upto, _ = _places(raw, min_words)
    return list(zip(a.tolist(), b.tolist(), _hashed(raw, a, b, upto)))


def _all_keys(min_words: int):
    """Keys of all runs; one that comes more than twice in a batch is sent twice."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            keys = np.sort(np.concatenate([np.empty(0, np.uint64), *(_places(t, min_words)[3] for t in texts if t)]))
            keep = np.ones(len(keys), bool)
            keep[2:] = keys[2:] != keys[:-2]
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64))], names=["key"])

    return released(run)


def _marked(keys: DataFrame):
    """The bit map of the keys that come more than once, sent to every task."""
    again = keys.groupBy("key").count().filter("count > 1")
    places = [F.col("key").bitwiseAND(F.lit(MAP_BITS - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(MAP_BITS - 1))]
    place = again.select(F.explode(F.array(*[p + 1 for p in places])).alias("place"))
    blocks = place.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    marks = np.zeros((MAP_BITS // _BLOCK, _BLOCK // 8), np.uint8)
    for row in blocks.toLocalIterator():
        marks[row["block"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(marks.reshape(-1))


def _are_marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        place = ((keys >> np.uint64(shift)) & np.uint64(MAP_BITS - 1)).astype(np.int64)
        out &= (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


def _marked_runs(min_words: int, held):
    low = (1 << 64) - 1

    def run(batches):
        marks = held.value
        for batch in batches:
            doc, th, first, last, again, h1, h2 = [], [], [], [], [], [], []
            for i, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                a, b, upto, keys = _places(text, min_words)
                some = _are_marked(marks, keys)
                if not some.any():
                    continue
                a, b, seen = a[some], b[some], {}
                for x, y, h in zip(a.tolist(), b.tolist(), _hashed(text, a, b, upto)):
                    again.append(seen.setdefault(h, x) != x)  # repeats an earlier place of its own text
                    doc.append(i), th.append(own), first.append(x), last.append(y), h1.append(h >> 64), h2.append(h & low)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(th, pa.int64()),
                    pa.array(first, pa.int32()),
                    pa.array(last, pa.int32()),
                    pa.array(again, pa.bool_()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                ],
                names=["doc", "th", "first", "last", "again", "h1", "h2"],
            )

    return released(run)


_NO_ID = (1 << 63) - 1


def _text_hash(text_col: str):
    return F.xxhash64(F.col(text_col))


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, th, ranges``: for each document (id and hash of the text) the ranges of pieces that repeat an earlier place."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), _text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    held = _marked(base.select("text").mapInArrow(_all_keys(min_words), "key long"))
    runs = written(base.mapInArrow(_marked_runs(min_words, held), _RUNS), "runs")
    held.unpersist()
    place = F.struct("doc", "th")
    seen = runs.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("h1", "h2", "low")
    later = runs.join(seen, ["h1", "h2"], "left").filter(F.col("again") | (place != F.col("low"))).select("doc", "th", "first", "last")
    ranges = later.groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))

    # overlapping and touching spans become one range
    def merge(acc, x):
        end = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] + 1 >= x["first"]), grown).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<first: int, last: int>>")
    return ranges.select("doc", "th", F.aggregate("spans", empty, merge).alias("ranges"))


_CLOSED = re.compile(r"(?:[.!?][ \t]+|\n)\Z")
_CUT = pa.struct([("text", pa.string()), ("sentences", pa.int64()), ("removed", pa.int64())])


def _cut_udf():
    @F.arrow_udf("struct<text: string, sentences: long, removed: long>")
    def run(text: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(text.to_pylist(), ranges.to_pylist()):
            if t and not spans:
                closed = {m.end() for m in _END.finditer(t)} - {len(t)}
                out.append({"text": t, "sentences": len(closed) + 1, "removed": 0})
                continue
            parts = sentences_of(t)
            gone = {i for s in spans or [] for i in range(s["first"], s["last"] + 1)}
            kept = "".join([p for i, p in enumerate(parts) if i not in gone]) if gone else t
            # pieces up to the end of a sentence are one sentence
            own = np.cumsum([0, *(bool(_CLOSED.search(p)) for p in parts[:-1])]).tolist() if parts else []
            out.append({"text": kept, "sentences": own[-1] + 1 if parts else 0, "removed": len({own[i] for i in gone})})
        return pa.array(out, _CUT)

    return run


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` without the pieces of repeated spans; ``counts`` names columns for sentences and those cut, whole or in part."""
    own_id, own_th, own_ranges, cut = fresh(docs, "range_doc", "range_th", "ranges", "cut")
    ranges = written(repeated_ranges(docs, id_col, text_col, min_words), "ranges").select(F.col("doc").alias(own_id), F.col("th").alias(own_th), F.col("ranges").alias(own_ranges))
    size = ranges.agg(F.coalesce(F.sum(F.size(own_ranges) * 16 + 72), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        ranges = F.broadcast(ranges)
    out = docs.join(ranges, (F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col(own_id)) & (_text_hash(text_col) == F.col(own_th)), "left")
    out = out.withColumn(cut, _cut_udf()(F.col(text_col), F.col(own_ranges))).withColumn(text_col, F.col(f"{cut}.text"))
    extra = [F.col(f"{cut}.sentences").alias(counts[0]), F.col(f"{cut}.removed").alias(counts[1])] if counts else []
    return out.select(*docs.columns, *extra)


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and cut sentences of every document, and what is left of its text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_spans(docs, counts=("n_sentences", "n_removed"))
    return out.select("doc_id", "n_sentences", "n_removed", F.length("text").alias("chars_kept"), F.md5("text").alias("kept_md5"))
