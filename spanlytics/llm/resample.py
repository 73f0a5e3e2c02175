"""Importance resampling towards a target corpus, by hashed n-gram features and Gumbel noise.

1. *Features* of a batch of texts come from Arrow kernels: ``ascii_lower``, ``split_pattern_regex``,
   ``list_flatten`` and ``dictionary_encode`` give word numbers; shifted by one they form pairs, and the
   dictionary of these pairs shifted once more forms triples. Only distinct words, pairs and triples get
   a CRC, which continues that of the shorter run; ``take`` brings it to every occurrence.
2. *Counts.* Each task adds up a table of ``BUCKETS`` numbers; tables are summed by bucket.
3. *Gains.* A bucket's gain is the rounded log of its smoothed share in the target over that in the
   source. A second pass takes the gain of every feature and adds them up by document (segment-reduce).
4. *Draw.* Gumbel noise from the hash of the id is added; the highest scores of eligible documents are
   drawn without replacement. Ranks come from a range partitioning by score: place within the partition
   plus the sizes of those before, so no task sorts everything.

Defined results: a null or empty text has no features, weight 0 and is never eligible; a null id is
hashed as the empty string and is last among equal scores; rows equal in score and id get different ranks
in any order; an empty table gives an empty result. Extra columns are not read. Texts of any length are
whole; a batch is worked on in slices of about ``SLICE_BYTES``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlytics.llm.common import query, read, shuffle_partitions, written

BUCKETS = 10_000
MAX_RUN = 3
MIN_WORDS = 20
PERCENT = 5
#: Text that is tokenised at once (a longer text is one slice).
SLICE_BYTES = 4 << 20

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row of each word, and the words as a dictionary array."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _SEPARATORS)
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(pc.binary_length(flat), 0)  # texts may begin or end with a separator
    return rows.filter(full).to_numpy(), flat.filter(full).dictionary_encode()


def features_of(texts: pa.Array, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each row, and for every run length the rows and buckets of its features."""
    row, words = words_of(texts)
    n_words = np.bincount(row, minlength=len(texts))
    tail = [b" " + w for w in pc.cast(words.dictionary, pa.binary()).to_pylist()]
    crc = list(map(zlib.crc32, (w[1:] for w in tail)))
    word = words.indices.to_numpy().astype(np.int64)
    run, out = word, []
    for length in range(1, max_run + 1):
        if length > 1:
            # a run continues by the next word of the same row
            keep = row[: len(run) - 1] == row[length - 1 :] if len(run) else np.empty(0, bool)
            last = word[length - 1 :]
            n = max(len(tail), 1)
            # a run that crosses into the next row is no feature, but keeps its place for the shift
            code = pa.array(run[: len(last)] * n + last).dictionary_encode()
            before, after = np.divmod(code.dictionary.to_numpy(), n)
            crc = [zlib.crc32(tail[w], crc[r]) for r, w in zip(before.tolist(), after.tolist())]
            run = code.indices.to_numpy().astype(np.int64)
            at = row[: len(run)][keep]
            taken = pc.take(pa.array(np.array(crc, np.int64) % buckets), pa.array(run[keep])).to_numpy()
        else:
            at, taken = row, pc.take(pa.array(np.array(crc, np.int64) % buckets), words.indices).to_numpy()
        out.append((at, taken))
    return n_words, out


def _slices(texts: pa.Array):
    """Consecutive slices (offset, part) of about ``SLICE_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(edges, edges[1:]):
        yield a, texts.slice(a, b - a)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """How many features of all rows fall in each bucket; the driver gets ``buckets`` numbers."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                for _, at in features_of(part, buckets, max_run)[1]:
                    total += np.bincount(at, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rounded log ratio of the smoothed share of each bucket in the target and in the source."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratios = ((t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""

    def run(batches):
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, part in _slices(batch.column(1)):
                count, runs = features_of(part, len(gain), max_run)
                b = a + len(part)
                n_words[a:b] = count
                for row, at in runs:
                    n = np.bincount(row, minlength=len(part))
                    sums = np.concatenate([[0], np.cumsum(pc.take(pa.array(gain), pa.array(at)).to_numpy())])
                    ends = np.cumsum(n)  # features lie in the order of their rows
                    n_features[a:b] += n
                    weight[a:b] += sums[ends] - sums[ends - n]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = 42):
    """Rounded Gumbel noise from the hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, order: list, where: str) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3... in the given order over the rows with ``where``; null elsewhere.

    The rows are written range by range; the sizes of the ranges are all that the driver sees.
    """
    parts = shuffle_partitions(scored.sparkSession)
    keyed = scored.filter(where).withColumn("salt", F.rand(7))  # rows equal in the order are spread
    ranges = keyed.repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order, "salt")
    placed = written(ranges.withColumn("place", F.monotonically_increasing_id()).drop("salt"), "ranges")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    sizes = dict(placed.groupBy("part").count().collect())  # one number for each partition
    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part], before = before, before + sizes[part]
    first = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.create_map().cast("map<bigint,bigint>")
    number = F.element_at(first, F.col("part")) + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    rest = scored.filter(~F.expr(where)).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", number.cast("long")).drop("place", "part").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; drawn documents have a rank."""
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "scored")  # small rows; the range partitioning reads them twice
    eligible = f"n_words >= {min_words}"
    drawn = scored.filter(eligible).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return ranked(scored, order, eligible).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


@query("op12_resample")
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark texts."""
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
