"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

The text is folded first (lower case, homoglyphs, digits that stand for letters, everything that is
not a letter becomes a space), so one automaton finds every spelling. An entry is a word beginning
(``" idio"``) or a whole word (``" idiot "``) with a weight. Hits inside an exception phrase do not
count. The sum of the weights and that sum per hundred words go through a fitted logistic curve.

The lexicon and the curve are learned from labelled rows: one half of a bounded sample gives a first
lexicon, the other half the curve over it, then the whole sample the final lexicon. ``FIT_ROWS``
bounds the sample.

Defined results: a null or empty text has no hit and gets the score of a text without hits; repeated
rows get equal scores; an empty table gives an empty result; without both labels in the sample the
lexicon is empty and every score is the share of toxic labels (0.0 without any label).
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlytics.llm.common import fresh, query, read

# Letters of other scripts and signs that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
# Digits read as letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
# Signs read as letters, but only between two letters.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
# Harmless phrases that contain a word of a lexicon of insults.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser award", "idiot proof")

#: At most about so many labelled rows are used for fitting.
FIT_ROWS = 12_000
THRESHOLD = 0.3
#: Log likelihood ratio that an entry needs; about the log of the number of candidates.
EVIDENCE = 9.0
PREFIXES = range(3, 9)


class _Folding(dict):
    """Translation table that learns a character when it first meets it."""

    def __missing__(self, code: int):
        char = chr(code)
        base = unicodedata.normalize("NFKC", char).lower()
        base = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in base)
        out = "".join(x if x.isalpha() or unicodedata.combining(x) else " " for x in base) or " "
        self[code] = out
        return out


_TABLE = _Folding()


def fold(text: str | None) -> str:
    """Folded words, each with a space before and after."""
    if not text:
        return " "
    if any(s in text for s in SIGNS):
        for sign, letter in SIGNS.items():
            at = text.find(sign)
            if at < 0:
                continue
            parts = text.split(sign)
            out = [parts[0]]
            for left, right in zip(parts, parts[1:]):
                out.append(letter if left[-1:].isalpha() and right[:1].isalpha() else sign)
                out.append(right)
            text = "".join(out)
    return f" {text.translate(_TABLE)} "


def entries_of(folded: str) -> set[str]:
    """Word beginnings and whole words that may become lexicon entries."""
    out = set()
    for word in set(folded.split()):
        out.update(f" {word[:k]}" for k in PREFIXES if k <= len(word))
        if len(word) >= 3:
            out.add(f" {word} ")
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "exceptions": self.exceptions, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            auto = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                auto.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                auto.add_word(folded := fold(phrase), (len(folded), None))
            if len(auto):
                auto.make_automaton()
            self._automaton = auto
        return self._automaton

    def hits(self, text: str | None) -> tuple[float, int]:
        """Sum of weights (the strongest entry of each word once) and the number of words."""
        folded = fold(text)
        auto = self.automaton()
        best: dict[int, float] = {}
        spared = []
        if len(auto):
            for end, (size, weight) in auto.iter(folded):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        for a, b in spared:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()), len(folded.split())

    def score(self, text: str | None) -> float:
        return float(_sigmoid(np.dot(self.curve, _features(*self.hits(text)))))


def _features(total: float, words: int) -> np.ndarray:
    return np.array([1.0, math.log1p(total), math.log1p(100.0 * total / max(words, 1))])


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def in_fit_half(doc_id, half: int):
    """Rows for the lexicon (0) or the curve (1)."""
    return F.crc32(F.concat(F.lit("half"), doc_id.cast("string"))) % 2 == half


def _partial_counts(batches):
    for batch in batches:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update(entries_of(fold(text)))
        # an entry never seen in a toxic text of the batch still matters for others: all go out
        keys = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict(
            {"entry": keys, "t": pa.array([toxic[k] for k in keys], pa.int64()), "c": pa.array([clean[k] for k in keys], pa.int64())}
        )


def _lexicon(sample: DataFrame, evidence: float, min_ratio: float, size: int) -> dict[str, float]:
    base = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = base.get(1, 0), base.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(_partial_counts, "entry string, t long, c long")
    counts = counts.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    # how far the share of toxic texts with the entry lies above that of all texts, as a log likelihood ratio
    base_share, n, share = n_toxic / (n_toxic + n_clean), F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    clean_part = F.when(F.col("c") > 0, (1 - share) * F.log((1 - share) / (1 - base_share))).otherwise(0.0)
    # a bounded list: the strongest entries by weight, then by support
    rows = (
        counts.filter("t > 0")
        .withColumn("w", weight)
        .filter((F.col("w") >= math.log(min_ratio)) & (n * (share * F.log(share / base_share) + clean_part) >= evidence))
        .orderBy(F.desc("w"), F.desc("t"), "entry")
        .limit(size)
        .collect()
    )
    return {r["entry"]: float(r["w"]) for r in rows}


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge-damped logistic regression by Newton steps on three columns."""
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        grad = x.T @ (p - y) + ridge @ beta
        hess = (x.T * (p * (1 - p))) @ x + ridge
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _hits_udf(model: ToxicityModel):
    kind = pa.struct([("total", pa.float64()), ("words", pa.int64())])

    @F.arrow_udf("struct<total double, words long>")
    def run(text: pa.Array) -> pa.Array:
        got = [model.hits(t) for t in text.to_pylist()]
        return pa.array([{"total": a, "words": b} for a, b in got], kind)

    return run


def fit(labelled: DataFrame, rows: int = FIT_ROWS, evidence: float = EVIDENCE, min_ratio: float = 12.0, size: int = 4000, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Fit from a frame with ``doc_id, text, toxic``; rows without a label are ignored."""
    use = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    seen = use.agg(F.count("*").alias("n"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("share")).first()
    if not seen["n"] or seen["share"] in (0.0, 1.0):
        share = seen["share"]
        return ToxicityModel({}, (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0), exceptions)
    keep = min(1.0, rows / seen["n"])
    sample = use.filter(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string"))) < int(keep * 2**32) + 1)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    weights = _lexicon(sample.filter(in_fit_half(key, 0)), evidence, min_ratio, size)
    model = ToxicityModel(weights, (0.0, 0.0, 0.0), exceptions)
    half = sample.filter(in_fit_half(key, 1)).select(_hits_udf(model)("text").alias("h"), "toxic")
    points = half.select("h.total", "h.words", "toxic").toPandas()  # at most half of ``rows`` small rows
    if not len(points):
        return ToxicityModel(weights, (math.log((seen["share"] + 1e-9) / (1 - seen["share"] + 1e-9)), 0.0, 0.0), exceptions)
    x = np.stack([_features(a, b) for a, b in zip(points["total"], points["words"])])
    curve = _curve(x, points["toxic"].to_numpy(float))
    return ToxicityModel(_lexicon(sample, evidence, min_ratio, size), curve, exceptions)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column; no other column is read for it."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``size`` entries

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        use = held.value
        return pa.array([use.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(out, run(F.col(text)))


def held_out(doc_id):
    """The rows that no fit may read: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_from_tables(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # the sample is cut from the small side before the texts are joined
    n = labels.count()
    keep = min(1.0, FIT_ROWS / max(n, 1))
    small = labels.filter(F.crc32(F.concat(F.lit("rows"), F.col("doc_id").cast("string"))) < int(keep * 2**32) + 1)
    return fit(docs.join(F.broadcast(small), "doc_id"))  # about FIT_ROWS rows at most


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels come only from rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_from_tables(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    (name,) = fresh(docs, "toxicity_score")
    return score(docs, model, out=name).filter(F.col(name) < threshold).drop(name)
