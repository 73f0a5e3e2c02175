"""Review records: JSON lines in two layouts, gold clean-up, writers and sampling guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanlytics.functions.core import col, let
from spanlytics.functions.labels import canonical_label

# Superset of the canonical and the release layout. Mixed label rows are text.
SCHEMA = """review_id string, id string, dataset string, text string, review string,
gold_spans array<struct<start: int, end: int, label: string, occurrence: int, raw_label: string>>,
label array<array<string>>, metadata map<string,string>, meta map<string,string>,
rid string, scores string, Comments string"""
SPAN = "struct<start:int,end:int,label:string,occurrence:int,raw_label:string>"


def trim_span(text, start, end) -> Column:
    """``struct<start, end>`` without boundary whitespace, by length arithmetic."""
    piece = F.substring(col(text), (start + 1).cast("int"), (end - start).cast("int"))

    def cut(p):
        lead = F.length(p) - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))
        tail = F.length(p) - F.length(F.regexp_replace(p, r"(?U)\s+$", ""))
        return F.struct((start + lead).cast("int").alias("start"), (end - tail).cast("int").alias("end"))

    return let(piece, cut)


def clean_gold(text, spans) -> Column:
    """Canonical labels, unknown labels and empty spans dropped, whitespace trimmed, stable order."""

    def one(s, i):
        return let(
            F.struct(canonical_label(s["label"]).alias("c"), trim_span(text, s["start"], s["end"]).alias("t")),
            lambda p: F.struct(
                p["t"]["start"].alias("start"),
                p["t"]["end"].alias("end"),
                i.alias("given"),
                p["c"]["label"].alias("label"),
                F.coalesce(s["occurrence"], p["c"]["occurrence"].cast("int")).alias("occurrence"),
                F.coalesce(s["raw_label"], s["label"]).alias("raw_label"),
            ),
        )

    kept = F.filter(F.transform(spans, one), lambda s: s["label"].isNotNull() & (s["end"] > s["start"]))
    return F.transform(
        F.array_sort(kept),
        lambda s: F.struct(s["start"], s["end"], s["label"], s["occurrence"], s["raw_label"]),
    ).cast(f"array<{SPAN}>")


def to_records(rows: DataFrame, dataset: str | None = None) -> DataFrame:
    """Rows of either layout to review_id, dataset, text, spans, metadata."""
    canonical = F.col("text").isNotNull() & F.col("review_id").isNotNull() & F.col("gold_spans").isNotNull()
    listed = F.transform(
        F.coalesce("label", F.array().cast("array<array<string>>")),
        lambda x: F.struct(
            x[0].cast("int").alias("start"), x[1].cast("int").alias("end"), x[2].alias("label"),
            F.lit(None).cast("int").alias("occurrence"), x[2].alias("raw_label"),
        ),
    ).cast(f"array<{SPAN}>")
    text = F.when(canonical, F.col("text")).otherwise(F.coalesce("review", "text"))
    extras = F.map_filter(
        F.create_map(F.lit("rid"), F.col("rid"), F.lit("scores"), F.col("scores"), F.lit("Comments"), F.col("Comments")),
        lambda k, v: v.isNotNull(),
    )
    empty = F.create_map().cast("map<string,string>")
    given = F.coalesce("meta", "metadata", empty)
    folded = F.map_concat(F.map_filter(given, lambda k, v: ~F.map_contains_key(extras, k)), extras)
    base = rows.select(
        F.coalesce("review_id", "id").alias("review_id"),
        (F.lit(dataset) if dataset else F.coalesce("dataset", F.lit("unknown"))).alias("dataset"),
        text.alias("text"),
        F.when(canonical, F.col("gold_spans")).otherwise(listed).alias("raw_spans"),
        F.when(canonical, F.coalesce("metadata", empty)).otherwise(folded).alias("metadata"),
    )
    return base.select("review_id", "dataset", "text", clean_gold("text", F.col("raw_spans")).alias("spans"), "metadata")


def read_records(spark: SparkSession, path, dataset: str | None = None) -> DataFrame:
    """JSON lines in the canonical or the release layout; blank lines are skipped."""
    return to_records(spark.read.schema(SCHEMA).json(path), dataset)


def read_split(spark: SparkSession, path, dataset: str, split: str, source: str, prefix: str) -> DataFrame:
    """A named split: prefixed ids; split and source fill in where the metadata lacks them."""
    rows = read_records(spark, path, dataset)
    defaults = F.create_map(F.lit("split"), F.lit(split), F.lit("source"), F.lit(source))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key("metadata", k))
    return rows.withColumns(
        {
            "review_id": F.concat(F.lit(f"{prefix}-{split}-"), "review_id"),
            "metadata": F.map_concat("metadata", missing),
        }
    )


def read_annotators(spark: SparkSession, paths: dict[str, str], dataset: str, prefix: str) -> DataFrame:
    """Union of one file per annotator with an ``annotator`` column."""
    out = None
    for name, path in sorted(paths.items()):
        part = read_records(spark, path, dataset).withColumns(
            {"annotator": F.lit(name), "review_id": F.concat(F.lit(f"{prefix}-"), "review_id")}
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_records(records: DataFrame, path: str, mode: str = "overwrite", form: str = "json") -> None:
    """Canonical layout as JSON lines (or another writer format)."""
    out = records.select("review_id", "dataset", "text", F.col("spans").alias("gold_spans"), "metadata")
    out.write.mode(mode).format(form).save(path)


def strip_gold(records: DataFrame) -> DataFrame:
    """Records without gold, for anything that must not see it."""
    return records.withColumn("spans", F.array().cast(f"array<{SPAN}>"))


def first_reviews(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` reviews by id."""
    return records.orderBy("review_id").limit(n)
