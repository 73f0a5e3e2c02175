"""A training-data pipeline: five stages over the table of documents, each written before the next.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a frame. All
but the last return the columns of their input. No stage reads a cap, a sample or a subset of its
documents; side tables come from ``sf_dir``.

1. toxicity: documents with a score of 0.3 or more go;
2. line dedup: lines that stand on more than 5 % of the documents of their source are cut out
   (``n_chars`` follows the text);
3. n-gram Jaccard join: one document of each group of near duplicates stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. byte-level BPE: number and digests of the ids of what is left.

Defined results: nulls in any column pass through the stages (a null text is not toxic, has no lines,
links with nothing and has no ids); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlytics import ship_package
from spanlytics.llm import bpe, decontam, jaccard, lines, toxicity
from spanlytics.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.reject(docs, toxicity.fit_from_tables(spark, sf_dir))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cut = lines.drop_site_lines(docs, "text", F.col("source"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.encoded_digests(docs, bpe.public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_texts),
]

#: The fitted score, the latent search and the merges have no SQL form; the tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the output of each is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
