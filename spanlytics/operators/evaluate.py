"""Span scoring: unit labels, per-label counts, micro metrics, threshold grid and pooling.

Inputs
    results  one row per scored review of a run: dataset, run keys, review_id
    pred     one row per predicted span: dataset, run keys, review_id, p_idx, ts, tj, start, end, label, status
    gold     one row per gold span: review_id, g_idx, ts, tj, start, end, label
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spanlytics.functions.core import count_if, ratio, with_prf
from spanlytics.functions.labels import LABELS, NONE, is_recovered, scoring_status
from spanlytics.operators.matching import KEYS, RUN_KEYS, greedy_match, overlap_pairs
from spanlytics.session import materialize, task_count

TAUS = [0.3, 0.5, 0.7, 0.9, 1.0]
PRIMARY_TAU = 0.5
#: Gold spans of a review whose units are made in one task.
UNIT_CHUNK = 256
SUMS = [
    "n_units",
    "n_correct",
    "n_scored",
    "n_pred",
    "n_exact",
    "n_normalized",
    "n_fuzzy",
    "n_rejected",
    "n_illegal",
    "exact_span_matches",
    "sum_best_iou",
]


def tau_grid(taus=None, primary: float = PRIMARY_TAU) -> list[float]:
    """Sorted grid that always holds the primary threshold."""
    return sorted(set(TAUS if taus is None else taus) | {primary})


def tp_name(tau: float) -> str:
    return f"tp_{int(round(tau * 1000)):04d}"


def prediction_view(pred: DataFrame) -> DataFrame:
    """Statuses as they are scored: a recovered span with a foreign label becomes illegal."""
    return pred.withColumn("status", scoring_status("status", "label"))


def unit_records(results: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per gold span and run: label by largest overlap, best IoU, exact hit.

    The gold spans of a review travel in chunks with the runs beside them, and become one row per span and run
    only where the pairs of the chunk are; all units of a chunk are made in one task.
    """
    part = ["review_id", "_chunk"]
    chunk = F.expr(f"cast(g_idx div {UNIT_CHUNK} as int)").alias("_chunk")
    runs = results.groupBy("review_id").agg(F.collect_set(F.struct(*KEYS)).alias("runs"))
    rank = F.struct(F.col("overlap").cast("int").alias("ov"), F.col("iou"), (-F.col("p_idx").cast("bigint")).alias("first"))
    hit = F.struct(*KEYS, "g_idx", F.col("g_label").alias("gold_label"), "p_label", rank.alias("rank"), "iou", "exact")

    tasks = task_count(gold.sparkSession)
    hits = pairs.select("*", chunk).repartition(tasks, *part).groupBy(*part).agg(F.collect_list(hit).alias("hits"))
    spans = gold.select("review_id", chunk, F.struct("g_idx", F.col("label").alias("gold_label")).alias("s"))
    spans = spans.groupBy(*part).agg(F.collect_list("s").alias("spans")).join(runs, "review_id", "left").repartition(tasks, *part)

    def unmet(r, s):
        return F.struct(
            *[r[k].alias(k) for k in KEYS],
            s["g_idx"].alias("g_idx"),
            s["gold_label"].alias("gold_label"),
            F.lit(None).cast("string").alias("p_label"),
            F.lit(None).cast("struct<ov:int,iou:double,first:bigint>").alias("rank"),
            F.lit(0.0).alias("iou"),
            F.lit(False).alias("exact"),
        )

    none = F.array().cast(hits.schema["hits"].dataType)
    base = F.flatten(F.transform("runs", lambda r: F.transform("spans", lambda s: unmet(r, s))))
    both = spans.join(hits, part, "left").select(*part, F.explode(F.concat(F.coalesce(base, none), F.coalesce("hits", none))).alias("u"))
    grouped = (
        both.select(*part, "u.*")
        .groupBy(*KEYS, *part, "g_idx", "gold_label")
        .agg(
            F.max_by("p_label", "rank").alias("pred_label"),
            F.max("iou").alias("best_iou"),
            F.bool_or("exact").alias("exact"),
        )
    )
    return grouped.select(
        *KEYS,
        "review_id",
        "g_idx",
        F.concat_ws("#", F.col("review_id").cast("string"), F.col("g_idx").cast("string")).alias("unit_id"),
        "gold_label",
        "pred_label",
        F.coalesce(F.col("pred_label") == F.col("gold_label"), F.lit(False)).cast("int").alias("correct"),
        "best_iou",
        F.col("exact").cast("int").alias("exact"),
    )


def confusion(units: DataFrame, by=("dataset", "backend", "config_id", "run", "round")) -> DataFrame:
    return units.groupBy(*by, F.col("gold_label").alias("gold"), F.coalesce("pred_label", F.lit(NONE)).alias("pred")).agg(
        F.count("*").alias("count")
    )


@dataclass
class Scores:
    """Row-level scoring frames of one evaluation; every table below is one aggregate over them."""

    results: DataFrame
    pred: DataFrame
    gold: DataFrame
    pairs: DataFrame
    units: DataFrame
    matches: DataFrame

    def counts(self, by: list[str], taus=(PRIMARY_TAU,), label: bool = True) -> DataFrame:
        """Counters per ``by`` (and label), with one true-positive column per threshold.

        All contributions are unioned and summed in one shuffle with map-side combine; reviews
        without any span keep a row through ``results``.
        """
        zero = F.lit(0)
        by_label = ["label"] if label else []
        group = [*by, *by_label]
        tp_cols = [tp_name(t) for t in taus]

        def shape(df: DataFrame, **values) -> DataFrame:
            lab = [values.pop("label").alias("label")] if label else []
            values.pop("label", None)
            counters = [
                values.get(c, F.lit(0.0) if c == "sum_best_iou" else zero)
                .cast("double" if c == "sum_best_iou" else "bigint")
                .alias(c)
                for c in ["n_reviews", *SUMS, *tp_cols]
            ]
            return df.select(*by, *lab, *counters)

        no_label = F.lit(None).cast("string")
        legal = is_recovered("status", "start", "end") & F.col("label").isin(LABELS)
        parts = [
            shape(self.results, label=no_label, n_reviews=F.lit(1)),
            shape(
                self.units,
                label=F.col("gold_label"),
                n_units=F.lit(1),
                n_correct=F.col("correct"),
                exact_span_matches=F.col("exact"),
                sum_best_iou=F.col("best_iou"),
            ),
            shape(
                self.pred,
                label=F.when(legal, F.col("label")),
                n_scored=legal.cast("int"),
                n_pred=F.lit(1),
                n_exact=(F.col("status") == "exact").cast("int"),
                n_normalized=(F.col("status") == "normalized").cast("int"),
                n_fuzzy=(F.col("status") == "fuzzy").cast("int"),
                n_rejected=(F.col("status") == "rejected").cast("int"),
                n_illegal=(F.col("status") == "illegal_label").cast("int"),
            ),
            shape(
                self.matches,
                label=F.col("g_label"),
                **{tp_name(t): (F.col("iou") >= F.lit(t)).cast("int") for t in taus},
            ),
        ]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ["n_reviews", *SUMS, *tp_cols]])


def score(results: DataFrame, pred: DataFrame, gold: DataFrame) -> Scores:
    """Scoring frames. Predictions for reviews without a result row are skipped.

    Gold spans and pairs are written once: units, matches and counters all read them.
    """
    known = results.select("review_id").distinct()
    view = prediction_view(pred).join(known, "review_id", "left_semi")
    gold = materialize(gold)
    pairs = materialize(overlap_pairs(view, gold))
    return Scores(
        results=results,
        pred=view,
        gold=gold,
        pairs=pairs,
        units=unit_records(results, gold, pairs),
        matches=greedy_match(pairs),
    )


def at_taus(counts: DataFrame, keys: list[str], taus, policy: str = "count_as_fp") -> DataFrame:
    """Turn the per-threshold columns into rows and add fp and fn."""
    arr = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(tp_name(t)).alias("tp")) for t in taus])
    extra = F.col("n_illegal") + (F.col("n_rejected") if policy == "count_as_fp" else F.lit(0))
    rest = [c for c in ["n_reviews", *SUMS] if c in counts.columns and c != "n_scored"]
    return counts.select(*keys, *rest, "n_scored", F.inline(arr)).select(
        *keys,
        "tau",
        *rest,
        "tp",
        (F.col("n_scored") - F.col("tp") + extra).alias("fp"),
        (F.col("n_units") - F.col("tp")).alias("fn"),
    )


def with_rates(df: DataFrame) -> DataFrame:
    """Metrics from pooled counts, plus the five alignment rates."""
    return with_prf(df).withColumns(
        {
            "recoverable_span_rate": ratio(F.col("n_exact") + F.col("n_normalized") + F.col("n_fuzzy"), "n_pred"),
            "rejected_span_rate": ratio("n_rejected", "n_pred"),
            "fuzzy_span_rate": ratio("n_fuzzy", "n_pred"),
            "exact_span_match_rate": ratio("exact_span_matches", "n_units"),
            "mean_token_iou": ratio("sum_best_iou", "n_units"),
        }
    )


def review_counts(scores: Scores, tau: float = PRIMARY_TAU, policy: str = "count_as_fp") -> DataFrame:
    keys = [*KEYS, "review_id"]
    return at_taus(scores.counts(keys, [tau], label=False), keys, [tau], policy)


def review_counts_wide(scores: Scores, tau: float = PRIMARY_TAU) -> DataFrame:
    """Per review, one column per label and counter (``<label>__<counter>``), fixed pivot values."""
    keys = [*KEYS, "review_id"]
    per_label = scores.counts(keys, [tau])
    cells = []
    for name in LABELS:
        here = F.col("label") == name

        def total(value, here=here):
            return F.sum(F.when(here, value).otherwise(0))

        tp = F.col(tp_name(tau))
        cells += [
            total(F.col("n_units")).alias(f"{name}__units"),
            total(F.col("n_correct")).alias(f"{name}__correct"),
            total(tp).alias(f"{name}__tp"),
            total(F.col("n_scored") - tp).alias(f"{name}__fp"),
            total(F.col("n_units") - tp).alias(f"{name}__fn"),
            total(F.col("n_scored")).alias(f"{name}__n_pred"),
        ]
    return per_label.groupBy(*keys).agg(*cells)


def label_metrics(counts: DataFrame, keys: list[str], taus, pooled: bool = False) -> DataFrame:
    """Per-label counters and metrics; rejected and illegal spans belong to no label.

    ``counts`` holds counters per (keys, label); labels without any span get zero rows. With ``pooled`` the
    same aggregate also gives rows of ``dataset='pooled'``, summed over datasets where there are several.
    """
    tp_cols = [tp_name(t) for t in taus]
    used = ["n_units", "n_correct", "n_scored", *tp_cols]
    counts = materialize(counts.select(*keys, "label", *used))  # read twice, and as small as the table
    domain = counts.select(*keys).distinct().select(
        *keys,
        F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label"),
        *[F.lit(0).cast("bigint").alias(c) for c in used],
    )
    full = counts.filter(F.col("label").isin(LABELS)).select(*keys, "label", *used).unionByName(domain)
    sums = [F.sum(c).alias(c) for c in used]
    if pooled:
        sets = [[*keys, "label"], [*[k for k in keys if k != "dataset"], "label"]]
        both = full.withColumn("_of", F.col("dataset")).groupingSets([[F.col(c) for c in s] for s in sets], *keys, "label")
        full = both.agg(*sums, F.grouping("dataset").alias("_all"), F.countDistinct("_of").alias("_datasets"))
        full = full.filter("_all = 0 or _datasets >= 2").withColumn("dataset", F.when(F.col("_all") == 1, F.lit("pooled")).otherwise(F.col("dataset")))
    else:
        full = full.groupBy(*keys, "label").agg(*sums)
    arr = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(tp_name(t)).alias("tp")) for t in taus])
    rows = full.select(*keys, "label", "n_units", "n_correct", "n_scored", F.inline(arr))
    return with_prf(
        rows.select(
            *keys,
            "label",
            "tau",
            F.col("n_units").alias("units"),
            F.col("n_correct").alias("correct"),
            "tp",
            (F.col("n_scored") - F.col("tp")).alias("fp"),
            (F.col("n_units") - F.col("tp")).alias("fn"),
            F.col("n_scored").alias("n_pred"),
        ),
        units="units",
        correct="correct",
    )


def pool_datasets(counts: DataFrame, keys=RUN_KEYS, extra: list[str] = ()) -> DataFrame:
    """Rows with ``dataset='pooled'``: counts summed over datasets, only where there are several."""
    numeric = [c for c, t in counts.dtypes if c not in {"dataset", *keys, *extra}]
    pooled = counts.groupBy(*keys, *extra).agg(
        F.countDistinct("dataset").alias("_datasets"), *[F.sum(c).alias(c) for c in numeric]
    )
    return (
        pooled.filter(F.col("_datasets") >= 2).drop("_datasets").withColumn("dataset", F.lit("pooled")).select(*counts.columns)
    )


def master_results(scores: Scores, taus=None, policy: str = "count_as_fp", datasets=None) -> DataFrame:
    """Micro metrics and rates per dataset x run x tau, with pooled rows."""
    grid = tau_grid(taus)
    counts = scores.counts(KEYS, grid, label=False)
    if datasets:
        counts = counts.filter(F.col("dataset").isin(list(datasets)))
    counts = counts.unionByName(pool_datasets(counts))
    return with_rates(at_taus(counts, KEYS, grid, policy))


def pooled_manifest(runs: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Pooled run descriptions: distinct hashes joined by ``|``, counters summed when present."""
    text = ["dataset_hash", "prompt_hash", "spec_hash", "models_returned"]
    counters = ["n_llm_calls", "total_retries", "n_flagged", "n_errors"]
    return (
        runs.groupBy(*keys)
        .agg(
            F.countDistinct("dataset").alias("_datasets"),
            *[
                F.array_join(F.sort_array(F.collect_set(F.coalesce(c, F.lit("")))), "|").alias(c)
                for c in text
                if c in runs.columns
            ],
            *[F.sum(c).alias(c) for c in counters if c in runs.columns],
        )
        .filter(F.col("_datasets") >= 2)
        .drop("_datasets")
        .withColumn("dataset", F.lit("pooled"))
    )


def skipped_predictions(pred: DataFrame, results: DataFrame) -> DataFrame:
    """Predictions whose review is not in the evaluated set."""
    return pred.join(results.select("review_id"), "review_id", "left_anti")


def status_rates(pred: DataFrame, by: list[str]) -> DataFrame:
    view = prediction_view(pred)
    return view.groupBy(*by).agg(
        F.count("*").alias("n_pred"),
        *[
            count_if(F.col("status") == s).alias(f"n_{s}")
            for s in ("exact", "normalized", "fuzzy", "rejected", "illegal_label")
        ],
    )
