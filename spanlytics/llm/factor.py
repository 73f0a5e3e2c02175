"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector of three blocks, each of length one: hashed words (log counts), hashed
shapes of words (``Aa9#``), and one bin for each structure statistic and for the declared length. The
score is the logistic of

    w0 + sum w_i x_i + 1/2 (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2)

where the last part is the sum over all pairs of features of their factors' product, brought to linear
time by the sum-of-squares identity. So a shape, a statistic and a word can weigh together what neither
weighs alone, with ``FACTORS`` numbers for each feature.

Fitting: at most about ``FIT_ROWS`` labelled rows are turned to vectors on the cluster and written once;
each of ``PASSES`` passes adds up the gradient of all of them by task and the driver takes one Adam step.
Bins lie between quantiles of the sample. Everything that a pass sends is of fixed size.

Defined results: a null or empty text has no words and the score of an empty text; a null length has a bin
of its own; equal rows get equal scores; an empty table gives an empty result; with one label only every
score is near that label, without labels 0.5. Rows without a label, or with another than 0 and 1, are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlytics.llm.common import query, read, written

#: At most about so many labelled rows are used for fitting (twice as many where ids repeat).
FIT_ROWS = 4_000
#: The sample is bounded, and so is the number of its parts.
FIT_PARTS = 8
PASSES, STEP, DECAY, FACTORS = 40, 0.15, 1e-5, 8
THRESHOLD = 0.3
WORDS, SHAPES, BINS = 1 << 14, 1 << 10, 8
#: Distinct words whose hashes and counts a worker keeps.
KEPT_WORDS = 200_000

STATS = (
    "words", "word_length", "letters", "capitals", "digits", "symbols", "points", "exclamations", "distinct_words",
    "repeated_runs", "repeated_lines", "words_per_line", "lines", "ended_lines", "short_words", "declared_length", "length_gap",
)
_FEATURES = "row long, label int, stats array<double>, at array<int>, x array<double>"


class _Kinds(dict):
    """Translation of characters to ``A``, ``a``, ``9`` or, for others, what ``other`` gives."""

    def __init__(self, other):
        self.other = other

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else self.other(c)
        return out


_SHAPE = _Kinds(lambda c: c)
_KIND = _Kinds(lambda c: "." if c in ".,;:!?'\"()-" else "#")
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def _shape(word: str) -> str:
    return _RUN.sub(r"\1", word.translate(_SHAPE))[:8]


class _Words(dict):
    """Number of each distinct word; its row of ``table`` holds what counts of it."""

    def __init__(self):
        self.table = np.zeros((1 << 12, 10), np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        if number == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        kind = word.translate(_KIND)
        capitals = kind.count("A")
        self.table[number] = (
            zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS, WORDS + zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % SHAPES, len(word),
            capitals + kind.count("a"), capitals, kind.count("9"), kind.count("#"), kind.count("."), word.count("!"), len(word) <= 3,
        )
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_KNOWN = _Words()


def vector_of(text: str | None, declared: int | None) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, places and values of the hashed blocks."""
    text = text or ""
    words = text.split()
    numbers = _KNOWN.numbers(words)
    distinct, times = np.unique(numbers, return_counts=True)
    about = _KNOWN.table[distinct]
    n = max(len(words), 1)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    runs = numbers[: len(numbers) - 3].astype(np.uint64)
    for k in range(1, 4 if len(numbers) > 3 else 1):
        with np.errstate(over="ignore"):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + numbers[k : len(numbers) - 3 + k].astype(np.uint64)
    length, letters, capitals, digits, symbols, points, shouts, short = (times @ about[:, 2:]).tolist()
    chars = max(length, 1)
    gap = float("nan") if declared is None else abs(declared - len(text))
    stats = [
        np.log1p(len(words)), length / n, letters / chars, capitals / chars, digits / chars, symbols / n, points / n, shouts / n, len(distinct) / n,
        1 - len(np.unique(runs)) / len(runs) if len(words) > 3 else 0.0, 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), np.log1p(len(lines)),
        sum(x[-1] in ".!?\"'”»)" for x in lines) / max(len(lines), 1), short / n, float("nan") if declared is None else np.log1p(max(declared, 0)), np.log1p(gap),
    ]
    places, values = [], []
    for column, first, size in ((0, 0, WORDS), (1, WORDS, SHAPES)):
        sums = np.bincount(about[:, column] - first, times, size)
        at = np.flatnonzero(sums)
        x = np.log1p(sums[at])
        places.append(at + first)
        values.append(x / (np.sqrt(x @ x) or 1.0))
    return [float(s) for s in stats], np.concatenate(places), np.concatenate(values)


@dataclass
class FactorModel:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    edges: np.ndarray
    _squares: np.ndarray | None = field(default=None, repr=False, compare=False)

    @classmethod
    def blank(cls, edges: np.ndarray, factors: int = FACTORS, seed: int = 1) -> FactorModel:
        size = WORDS + SHAPES + len(STATS) * (BINS + 1)
        return cls(0.0, np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (size, factors)), edges)

    def complete(self, stats, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector with the bins of its statistics."""
        stats = np.asarray(stats)
        bins = np.where(np.isnan(stats), BINS, (self.edges <= stats[:, None]).sum(1))
        own = WORDS + SHAPES + np.arange(len(STATS)) * (BINS + 1) + bins
        return np.concatenate([at, own]), np.concatenate([x, np.full(len(STATS), len(STATS) ** -0.5)])

    def logit(self, stats, at: np.ndarray, x: np.ndarray) -> float:
        if self._squares is None:
            self._squares = (self.factors**2).sum(1)
        at, x = self.complete(stats, at, x)
        mixed = x @ self.factors[at]
        return float(self.bias + x @ self.weights[at] + 0.5 * (mixed @ mixed - (x * x) @ self._squares[at]))

    def score(self, text: str | None, declared: int | None = None) -> float:
        return float(_sigmoid(self.logit(*vector_of(text, declared))))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def vectors(labelled: DataFrame, text: str = "text", length: str | None = "n_chars", label: str = "quality") -> DataFrame:
    """Labels, statistics and hashed blocks of every row."""

    def run(batches):
        for batch in batches:
            got = [vector_of(t, d) for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(3), batch.column(2), pa.array([s for s, _, _ in got], pa.list_(pa.float64())),
                    pa.array([a for _, a, _ in got], pa.list_(pa.int32())), pa.array([x for _, _, x in got], pa.list_(pa.float64())),
                ],
                names=["row", "label", "stats", "at", "x"],
            )

    declared = F.col(length).cast("long") if length else F.lit(None).cast("long")
    return labelled.select(F.col(text).cast("string"), declared.alias("d"), F.col(label).cast("int"), F.xxhash64(text).alias("row")).mapInArrow(run, _FEATURES)


def gradient(model: FactorModel, rows: list[tuple[int, list[float], np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the gradients of the log loss over rows: bias, weights, factors; then the number of rows and the loss."""
    full = [model.complete(s, at, x) for _, s, at, x in rows]
    sizes = np.array([len(at) for at, _ in full])
    at, x = np.concatenate([a for a, _ in full]), np.concatenate([v for _, v in full])
    y = np.array([label for label, *_ in rows], float)
    start = np.cumsum(sizes) - sizes
    xv = x[:, None] * model.factors[at]
    mixed = np.add.reduceat(xv, start)
    pairs = 0.5 * (mixed * mixed - np.add.reduceat(xv * xv, start)).sum(1)
    p = _sigmoid(model.bias + np.add.reduceat(x * model.weights[at], start) + pairs)
    pull = np.repeat(p - y, sizes) * x
    size = len(model.weights)
    by_factor = [np.bincount(at, pull * (np.repeat(mixed[:, k], sizes) - xv[:, k]), size) for k in range(xv.shape[1])]
    loss = -np.log(np.where(y == 1, p, 1 - p) + 1e-300).sum()
    return np.concatenate([[(p - y).sum()], np.bincount(at, pull, size), np.stack(by_factor, 1).ravel(), [len(y), loss]])


def _pass_over(sample: DataFrame, model: FactorModel) -> np.ndarray:
    """Gradient over all rows; every task sends one row of fixed size."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = 0.0
        for batch in batches:
            y, stats = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, x = batch.column(2), batch.column(3)
            if y:
                total = total + gradient(held.value, [(y[i], stats[i], at[i].values.to_numpy(), x[i].values.to_numpy()) for i in range(len(y))])
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    parts = sample.select("label", "stats", "at", "x").mapInArrow(run, "g binary").collect()
    held.unpersist()
    # in a fixed order, so that a run gives the same sums again
    return sum(np.frombuffer(g, np.float64) for g in sorted(bytes(r["g"]) for r in parts))


def fit(labelled: DataFrame, rows: int = FIT_ROWS, passes: int = PASSES, text: str = "text", length: str | None = "n_chars", label: str = "quality") -> FactorModel:
    """Fit from a frame with a text, a declared length and a label; at most ``2 * rows`` rows are used."""
    use = labelled.filter(F.col(label).isin(0, 1))
    sample = written(vectors(use, text, length, label).limit(2 * rows).repartition(FIT_PARTS, "row"), "vectors")
    stats = np.array([r["stats"] for r in sample.select("stats").collect()], float).reshape(-1, len(STATS))  # a few numbers for each row of the sample
    shares = np.arange(1, BINS) / BINS
    known = [s[~np.isnan(s)] for s in stats.T]
    edges = np.array([np.quantile(s, shares) if len(s) else np.zeros(BINS - 1) for s in known]).reshape(len(STATS), BINS - 1)
    model = FactorModel.blank(edges)
    if not len(stats):
        return FactorModel(0.0, model.weights, np.zeros_like(model.factors), edges)
    size, mean, square = len(model.weights), 0.0, 0.0
    for k in range(1, passes + 1):
        found = _pass_over(sample, model)
        params = np.concatenate([[model.bias], model.weights, model.factors.ravel()])
        step = found[:-2] / found[-2] + DECAY * np.concatenate([[0.0], params[1:]])
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step * step
        params = params - STEP * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        model = FactorModel(float(params[0]), params[1 : 1 + size], params[1 + size :].reshape(size, -1), edges)
    return model


def score(docs: DataFrame, model: FactorModel, text: str = "text", length: str | None = "n_chars", out: str = "score") -> DataFrame:
    """``docs`` with a score column; only the text and the declared length are read for it."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("double")
    def run(texts: pa.Array, declared: pa.Array) -> pa.Array:
        use = held.value
        return pa.array([use.score(t.as_py(), d) for t, d in zip(texts, declared.to_pylist())], pa.float64())

    return docs.withColumn(out, run(F.col(text).cast("string"), F.col(length).cast("long") if length else F.lit(None).cast("long")))


def held_out(doc_id):
    """The rows that no fit may read: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_from_tables(spark: SparkSession, sf_dir: str) -> FactorModel:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    keep = min(1.0, FIT_ROWS / max(labels.count(), 1))
    small = labels.filter(F.crc32(F.concat(F.lit("factor"), F.col("doc_id").cast("string"))) < int(keep * 2**32) + 1)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return fit(docs.join(F.broadcast(small), "doc_id"))  # about FIT_ROWS rows at most


@query("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels come only from rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score(docs, fit_from_tables(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
