"""Language identification by Bayesian fusion of evidence.

The log posterior of a language adds four parts:

* the text: naive Bayes over hashed character trigrams of the whole text, fitted on a bounded sample
  of labelled rows (``FIT_DOCS``), with the evidence of a text tempered to ``EVIDENCE`` trigrams, since
  neighbouring trigrams are not independent;
* the language declared in the markup and the suffix of the address: P(value | language), counted over
  all rows against the language of the text, with additive smoothing;
* the host: P(language | host), counted over all rows but the row itself, smoothed towards the host's
  domain, which is smoothed towards all rows (``PRIOR`` pseudo-rows at each step).

All counts are grouped aggregations with partial counts before the shuffle; the tables joined back hold
one row for a host, a domain or a value, and are sent to the tasks only below a checked size.

Defined results: a null or empty text gives no text evidence (its row still gets the language of the
other evidence, and does not count as evidence for others); a missing declaration, suffix or host adds
nothing; repeated rows count each; an empty table gives an empty result; without a labelled sample
there are no languages and the result is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanlytics.llm.common import BROADCAST_BYTES, query, read, written
from spanlytics.llm.lines import page_host, page_lines

FEATURES = 1 << 15
FIT_DOCS = 4000
EVIDENCE = 60.0
PRIOR = 5.0
SMOOTH = 0.5
KEEP = 0.5


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-case text; letters and spaces only."""
    if not text:
        return np.empty(0, np.int64)
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = (cp >= 97) & (cp <= 122) | (cp >= 0xC0)
    cp = np.where(letter, cp, np.uint64(32))
    cp = cp[letter | np.concatenate([[True], letter[:-1]])]  # runs of other characters become one space
    if len(cp) < 3:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = (cp[:-2] * np.uint64(0x9E3779B1) + cp[1:-1]) * np.uint64(0x85EBCA77C2B2AE63) + cp[2:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(49)).astype(np.int64)


def _count(batches):
    for batch in batches:
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total.setdefault(lang, np.zeros(FEATURES, np.int64))
            total[lang] += np.bincount(trigrams(text), minlength=FEATURES)
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "f": pa.array(used, pa.int32()), "n": pa.array(counts[used])})


def fit(labelled: DataFrame, rows: int = FIT_DOCS, languages: int = 64) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language) from a bounded sample of ``lang, text``."""
    known = labelled.filter("lang is not null and text is not null").select("lang", "text")
    n = known.count()
    keep = min(1.0, rows / max(n, 1))
    sample = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    counts = sample.mapInArrow(_count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()  # languages x FEATURES at most
    names = sorted(counts.groupby("lang")["n"].sum().nlargest(languages).index)
    table = np.full((FEATURES, len(names)), SMOOTH)
    for j, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[own["f"], j] += own["n"]
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def _likelihood(held):
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        table, out = held.value, []
        for t in texts.to_pylist():
            f = trigrams(t)
            ll = table[f].sum(axis=0, dtype=np.float64) * (min(1.0, EVIDENCE / len(f)) if len(f) else 0.0)
            out.append(None if not len(f) else (ll - ll.max()).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return run


def _small(df: DataFrame, row_bytes: int = 128) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _log_share(rows: DataFrame, value: str, names: list[str]) -> DataFrame:
    """``value, parts``: log P(value | language) for each language, from the languages of the texts."""
    seen = rows.filter(F.col(value).isNotNull() & F.col("text_lang").isNotNull())
    each = [F.sum(F.when(F.col("text_lang") == n, 1).otherwise(0)) for n in names]
    counts = seen.groupBy(value).agg(*[c.alias(f"n{j}") for j, c in enumerate(each)])
    totals = seen.agg(*[F.coalesce(c, F.lit(0)).alias(f"t{j}") for j, c in enumerate(each)], F.count_distinct(value).alias("values")).first()
    parts = [F.log((F.col(f"n{j}") + SMOOTH) / (totals[f"t{j}"] + SMOOTH * (totals["values"] + 1))) for j in range(len(names))]
    return counts.select(F.col(value).alias(f"{value}_key"), F.array(*parts).alias(f"{value}_part"))


def identified(df: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``df`` (with ``text, declared, suffix, host``) plus ``lang, confidence, text_lang``, without the text."""
    held = df.sparkSession.sparkContext.broadcast(table)
    langs = F.array(*[F.lit(n) for n in names])
    rows = df.withColumn("ll", _likelihood(held)("text")).drop("text")
    rows = rows.withColumn("text_lang", F.get(langs, F.array_position("ll", F.array_max("ll")).cast("int") - 1))
    rows = written(rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), "evidence")

    count = [F.sum(F.when(F.col("text_lang") == n, 1).otherwise(0)) for n in names]
    hosts = written(rows.groupBy("host", "domain").agg(F.array(*count).alias("host_n")).filter("host is not null"), "hosts")
    add = [F.sum(F.col("host_n")[j]) for j in range(len(names))]
    domains = hosts.groupBy("domain").agg(F.array(*add).alias("domain_n"))
    everything = rows.agg(F.array(*[F.coalesce(c, F.lit(0)) for c in count]).alias("n")).first()["n"]
    all_share = [(n + SMOOTH) / (sum(everything) + SMOOTH * len(names)) for n in everything]

    out = rows.join(_small(hosts.select(F.col("host").alias("host_key"), "host_n")), F.col("host") == F.col("host_key"), "left")
    out = out.join(_small(domains.withColumnRenamed("domain", "domain_key")), F.col("domain") == F.col("domain_key"), "left")
    for value in ("declared", "suffix"):
        out = out.join(_small(_log_share(rows, value, names)), F.col(value) == F.col(f"{value}_key"), "left")

    def total(parts: list[Column]) -> Column:
        return sum(parts[1:], parts[0])

    # a row does not count as evidence for itself
    own = [F.when(F.col("text_lang") == n, 1).otherwise(0) for n in names]
    host_n = [F.coalesce(F.col("host_n")[j] - own[j], F.lit(0)) for j in range(len(names))]
    domain_n = [F.coalesce(F.col("domain_n")[j] - own[j], F.lit(0)) for j in range(len(names))]
    domain_share = [(domain_n[j] + PRIOR * all_share[j]) / (total(domain_n) + PRIOR) for j in range(len(names))]
    prior = [F.log((host_n[j] + PRIOR * domain_share[j]) / (total(host_n) + PRIOR)) for j in range(len(names))]
    score = [prior[j] + total([F.coalesce(F.col(c)[j], F.lit(0.0)) for c in ("ll", "declared_part", "suffix_part")]) for j in range(len(names))]
    out = out.withColumn("score", F.array(*score)).withColumn("top", F.array_max("score"))
    weight = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = out.withColumns({"lang": F.get(langs, F.array_position("score", F.col("top")).cast("int") - 1), "confidence": 1 / weight})
    return out.select(*[c for c in df.columns if c != "text"], "lang", "confidence", "text_lang")


def page_evidence(pages: DataFrame) -> DataFrame:
    """``text, declared, suffix, host`` of raw pages beside their own columns."""
    declared = F.lower(F.regexp_extract("html", r'(?i)<html[^>]*\blang\s*=\s*["\']?([a-z]{2,3})', 1))
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    tld = F.regexp_extract(page_host("url"), r"\.([a-z]{2,})$", 1)
    some = lambda c: F.when(F.length(c) > 0, c)
    return pages.withColumns({"text": page_lines("html"), "declared": some(declared), "suffix": F.coalesce(some(path), some(tld)), "host": some(page_host("url"))})


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page by all evidence, and of every document by its text and its source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    names, table = fit(docs.select("lang", "text"))
    nothing = F.lit(None).cast("string")
    pages = page_evidence(read(spark, sf_dir, "pages")).select(F.lit("pages").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "suffix", "host")
    texts = docs.select(F.lit("documents").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text", nothing.alias("declared"), nothing.alias("suffix"), F.col("source").alias("host"))
    found = identified(pages.unionByName(texts), names, table)
    return found.select("kind", "doc_id", "page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", (F.col("confidence") >= KEEP).alias("kept"))
