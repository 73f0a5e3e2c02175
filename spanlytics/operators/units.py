"""Annotation units, corpus statistics, content hashes, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spanlytics.functions.core import let, slice_text, stable_hash
from spanlytics.functions.labels import LABELS, NONE
from spanlytics.functions.text import sentence_offsets, sentence_ranges, structure_flags
from spanlytics.functions.tokens import overlap, token_count, token_offsets
from spanlytics.operators.matching import BLOCK


def gold_units(reviews: DataFrame) -> DataFrame:
    """One unit per gold span; ``reviews`` hold ``spans: array<struct<start, end, label, ...>>``."""
    rows = reviews.select("review_id", "dataset", "text", F.posexplode("spans").alias("g_idx", "s"))
    return rows.select(
        F.concat_ws("#", F.col("review_id").cast("string"), F.col("g_idx").cast("string")).alias("unit_id"),
        "review_id",
        "dataset",
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.col("s.label").alias("gold_label"),
        slice_text("text", "s.start", "s.end").alias("text"),
    )


def sentences(reviews: DataFrame) -> DataFrame:
    """One row per sentence: review_id, dataset, k, start, end, text. Built within the row."""
    cut = reviews.select("review_id", "dataset", "text", sentence_offsets("text").alias("o"))
    rows = cut.select("review_id", "dataset", "text", F.posexplode(F.arrays_zip("o.s", "o.e")).alias("k", "b"))
    return rows.select(
        "review_id", "dataset", "k", F.col("b.s").alias("start"), F.col("b.e").alias("end"),
        slice_text("text", "b.s", "b.e").alias("text"),
    )


def ranged_sentences(reviews: DataFrame) -> DataFrame:
    """One row per sentence with its token range: review_id, k, start, end, ts, tj. Tokens come with the row; nothing is shuffled."""
    cut = reviews.select("review_id", sentence_ranges("text").alias("o"))
    rows = cut.select("review_id", F.posexplode(F.arrays_zip("o.s", "o.e", "o.ts", "o.tj")).alias("k", "b"))
    return rows.select("review_id", "k", F.col("b.s").alias("start"), F.col("b.e").alias("end"), "b.ts", "b.tj")


def label_sentences(sents: DataFrame, gold: DataFrame, block: int = BLOCK) -> DataFrame:
    """Label each sentence by the gold span of largest token overlap (first one wins), else ``None``.

    ``sents`` and ``gold`` carry token ranges. Overlaps come from an equi-join on token blocks; the
    union keeps sentences without any overlap.
    """

    def blocks(df):
        return df.filter(F.col("tj") > F.col("ts")).withColumn(
            "block", F.explode(F.sequence(F.expr(f"ts div {block}"), F.expr(f"(tj - 1) div {block}")))
        )

    g = blocks(gold).select(
        "review_id", "block", "g_idx", "label", F.col("ts").alias("g_ts"), F.col("tj").alias("g_tj")
    )
    shared = overlap("ts", "tj", "g_ts", "g_tj")
    hits = (
        blocks(sents)
        .join(g, ["review_id", "block"])
        .filter((shared > 0) & (F.col("block") == F.expr(f"greatest(ts, g_ts) div {block}")))
        .select("review_id", "k", "label", F.struct(shared.alias("ov"), (-F.col("g_idx")).alias("first")).alias("rank"))
    )
    best = hits.groupBy("review_id", "k").agg(F.max_by("label", "rank").alias("label"))
    joined = sents.join(best, ["review_id", "k"], "left")
    return joined.withColumns(
        {
            "label": F.coalesce("label", F.lit(NONE)),
            "unit_id": F.concat(F.col("review_id").cast("string"), F.lit("#s"), F.col("k").cast("string")),
        }
    )


def context_windows(reviews: DataFrame, width: int) -> DataFrame:
    """Each sentence with the previous ``width`` sentences joined by a space, built in the row."""
    cut = reviews.select("review_id", "text", sentence_offsets("text").alias("o"))
    texts = F.transform(F.arrays_zip("o.s", "o.e"), lambda b: slice_text("text", b["s"], b["e"]))
    held = cut.select("review_id", F.explode(F.array(texts)).alias("sents"))
    rows = held.select("review_id", "sents", F.posexplode("sents").alias("k", "text"))
    begin = F.greatest(F.lit(0), F.col("k") - width)
    return rows.select(
        "review_id", "k", "text", F.array_join(F.slice("sents", begin + 1, F.col("k") - begin), " ").alias("context")
    )


def _label_count(label: str):
    return F.size(F.filter("spans", lambda s: s["label"] == label))


def corpus_statistics(reviews: DataFrame, by: list[str] = ()) -> DataFrame:
    """Review and unit counts, tokens per unit, label counts and shares, offset ranges.

    Needs ``spans: array<struct<start, end, label, ts, tj>>``; all in one aggregate.
    """
    per = reviews.select(
        *by,
        F.size("spans").alias("n"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["tj"] - s["ts"])).alias("tokens"),
        *[_label_count(lab).alias(f"n_{lab}") for lab in LABELS],
        F.array_min(F.transform("spans", lambda s: s["start"])).alias("s0"),
        F.array_max(F.transform("spans", lambda s: s["start"])).alias("s1"),
        F.array_min(F.transform("spans", lambda s: s["end"])).alias("e0"),
        F.array_max(F.transform("spans", lambda s: s["end"])).alias("e1"),
    )
    agg = per.groupBy(*by).agg(
        F.count("*").alias("total_reviews"),
        F.sum("n").alias("total_units"),
        F.sum("tokens").alias("unit_tokens"),
        *[F.sum(f"n_{lab}").alias(f"n_{lab}") for lab in LABELS],
        F.min("s0").alias("start_min"),
        F.max("s1").alias("start_max"),
        F.min("e0").alias("end_min"),
        F.max("e1").alias("end_max"),
    )
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    units, revs = F.col("total_units"), F.col("total_reviews")
    return agg.select(
        *by,
        "total_reviews",
        "total_units",
        F.bround(safe(units, revs), 2).alias("avg_units_per_review"),
        F.bround(safe(F.col("unit_tokens"), units), 2).alias("avg_tokens_per_unit"),
        *[F.col(f"n_{lab}") for lab in LABELS],
        *[F.bround(safe(F.col(f"n_{lab}"), units), 4).alias(f"share_{lab}") for lab in LABELS],
        "start_min",
        "start_max",
        "end_min",
        "end_max",
    )


def record_digest(reviews: DataFrame) -> DataFrame:
    """Per review: text hash, size, span count and the hash of (id, text hash, spans)."""
    spans = F.array_join(
        F.transform(
            "spans",
            lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"), s["label"]),
        ),
        ";",
    )
    text_hash = F.sha2("text", 256)
    return reviews.select(
        "review_id",
        "dataset",
        text_hash.alias("text_sha256"),
        F.length("text").alias("n_chars"),
        F.size("spans").alias("n_gold_spans"),
        F.sha2(F.concat_ws("\t", F.col("review_id").cast("string"), text_hash, spans), 256).alias("digest"),
    )


def dataset_hash(digests: DataFrame, by: list[str] = (), levels=(5, 2, 0)) -> DataFrame:
    """Order-independent content hash as a hash tree over digest prefixes.

    Equal digests are counted first, then each level hashes the sorted hashes that share a prefix,
    so no step gathers more than a thin slice of the corpus.
    """
    node = digests.groupBy(*by, "digest").count().select(
        *by, F.concat_ws(":", "digest", F.col("count").cast("string")).alias("h"), F.col("digest").alias("p")
    )
    for n in levels:
        node = (
            node.withColumn("p", F.left("p", F.lit(n)))
            .groupBy(*by, "p")
            .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
        )
    return node.select(*by, F.col("h").alias("dataset_hash"))


def corpus_profile(reviews: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean and median size, and shares of three structural markers, with the notes they trigger."""
    flags = structure_flags("text")
    per = reviews.select(
        *by,
        token_count("text").alias("tokens"),
        F.size(sentence_offsets("text")["s"]).alias("sents"),
        F.greatest(F.lit(1), F.regexp_count("text", F.lit("\n")) + 1).alias("paras"),
        *[v.cast("int").alias(k) for k, v in flags.items()],
    )
    agg = per.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        F.bround(F.avg("tokens"), 1).alias("mean_tokens"),
        F.median("tokens").alias("median_tokens"),
        F.bround(F.avg("sents"), 1).alias("mean_sentences"),
        F.bround(F.avg("paras"), 1).alias("mean_paragraphs"),
        *[F.bround(F.avg(k), 3).alias(f"{k}_fraction") for k in flags],
    )
    sections = (F.col("reviewer_header_fraction") > 0.2) | (F.col("round_marker_fraction") > 0.2)
    return agg.withColumn(
        "notes",
        F.concat_ws(
            ";", F.when(sections, F.lit("sections")), F.when(F.col("mean_tokens") > 600, F.lit("long reports"))
        ),
    )


def select_exemplars(reviews: DataFrame, exclude: DataFrame | None = None, n: int = 3) -> DataFrame:
    """Greedy choice of ``n`` reviews: most labels not yet covered, then shortest, then lowest id.

    Only label sets and lengths take part; each of the ``n`` steps is one top-1 aggregate.
    """
    pool = reviews.filter(F.size("spans") >= 2)
    if exclude is not None:
        pool = pool.join(exclude.select("review_id"), "review_id", "left_anti")
    cards = pool.select(
        "review_id", F.length("text").alias("n_chars"), F.array_distinct(F.transform("spans", lambda s: s["label"])).alias("labels")
    )
    chosen, covered = [], []
    for _ in range(n):
        have = F.array(*[F.lit(x) for x in covered]).cast("array<string>")
        gain = F.size(F.array_except("labels", have))
        left = cards.filter(~F.col("review_id").isin(chosen)) if chosen else cards
        top = left.agg(
            F.min_by(F.struct("review_id", "labels"), F.struct((-gain).alias("g"), "n_chars", "review_id")).alias("t")
        ).first()["t"]
        if top is None:
            break
        chosen.append(top["review_id"])
        covered = sorted(set(covered) | set(top["labels"]))
    order = F.array(*[F.lit(x) for x in chosen]) if chosen else F.array().cast("array<string>")
    return reviews.filter(F.col("review_id").isin(chosen)).withColumn("position", F.array_position(order, F.col("review_id")))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows per group in a fixed random order; only rows that can still win are sorted.

    Rows are first cut to the best ``n`` per salted subgroup, so a group holding most rows is
    ranked in many tasks.
    """
    draw = stable_hash(F.lit(seed), key)
    salted = df.withColumns({"_draw": draw, "_salt": F.pmod(F.xxhash64(key), F.lit(64))})
    order = [F.col("_draw"), F.col(key)]
    local = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)))
    best = local.filter(F.col("_r") <= n).withColumn(
        "_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))
    )
    return best.filter(F.col("_r") <= n).drop("_draw", "_salt", "_r")


def grouped_split(df: DataFrame, key: str, fraction: float = 0.10, seed: int = 0) -> DataFrame:
    """Mark rows ``val`` or ``train`` by whole ids: the ids with the lowest draws are validation.

    The cut is the draw of the last validation id; it comes from counts per draw prefix and one
    top-k within a single prefix, so ids are never sorted as a whole.
    """
    ids = df.select(key).distinct().withColumn("_draw", stable_hash(F.lit(seed), key))
    total = ids.count()
    n_val = max(1, int(total * fraction))
    prefix = F.shiftright("_draw", 20)
    per_prefix = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    counts = ids.groupBy(prefix.alias("_p")).count().withColumn("_upto", F.sum("count").over(per_prefix))
    edge = counts.filter(F.col("_upto") >= n_val).orderBy("_p").select("_p", "_upto", "count").first()
    rest = n_val - (edge["_upto"] - edge["count"])
    last = ids.filter(prefix == edge["_p"]).orderBy("_draw", key).limit(rest).agg(F.max(F.struct("_draw", key)).alias("m")).first()["m"]
    pos = F.struct(stable_hash(F.lit(seed), key).alias("_draw"), F.col(key))
    cut = F.struct(F.lit(last["_draw"]).cast("bigint").alias("_draw"), F.lit(last[key]).alias(key))
    return df.withColumn("part", F.when(pos <= cut, F.lit("val")).otherwise(F.lit("train")))


def with_token_ranges_in_row(reviews: DataFrame, spans: str = "spans") -> DataFrame:
    """Token ranges for the char spans of each row, for rows whose span list is short."""
    tok = reviews.withColumn("_tok", token_offsets("text"))
    starts, ends = F.col("_tok.s"), F.col("_tok.e")

    def ranged(s):
        i = F.size(F.filter(ends, lambda x: x <= s["start"]))
        j = F.size(F.filter(starts, lambda x: x < s["end"]))
        k = F.size(F.filter(starts, lambda x: x < s["start"]))
        return let(
            F.struct(i.alias("i"), j.alias("j"), k.alias("k")),
            lambda r: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"),
                F.when(r["j"] > r["i"], r["i"]).otherwise(r["k"]).alias("ts"),
                F.when(r["j"] > r["i"], r["j"]).otherwise(r["k"]).alias("tj"),
            ),
        )

    return tok.withColumn(spans, F.transform(spans, ranged)).drop("_tok")
