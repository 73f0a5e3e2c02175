"""Report tables from the master and per-label results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanlytics.functions.core import prf_columns, with_prf
from spanlytics.functions.labels import label_order
from spanlytics.operators.evaluate import PRIMARY_TAU, with_rates

SUMS = [
    "n_units", "n_correct", "tp", "fp", "fn", "n_pred", "n_exact", "n_normalized", "n_fuzzy", "n_rejected",
    "n_illegal", "exact_span_matches", "sum_best_iou",
]
RATES = ["exact_span_match_rate", "mean_token_iou", "recoverable_span_rate", "rejected_span_rate", "fuzzy_span_rate"]


def dataset_rank(order: dict[str, int] | None = None) -> Column:
    """Position of a dataset in the tables: given order, 9 for pooled rows, 5 for others."""
    rank = F.when(F.col("dataset") == "pooled", F.lit(9))
    for name, place in (order or {}).items():
        rank = rank.when(F.col("dataset") == name, F.lit(place))
    return rank.otherwise(F.lit(5))


def pooled_over_runs(master: DataFrame, tau: float = PRIMARY_TAU, round_: int = 1, order=None) -> DataFrame:
    """Counts summed over runs at one threshold and round, with recomputed metrics and rates."""
    view = master.filter((F.col("tau") == tau) & (F.col("round") == round_))
    if "alignment_applicable" not in view.columns:
        view = view.withColumn("alignment_applicable", F.lit(True))
    pooled = view.groupBy("dataset", "backend", "config_id").agg(
        F.bool_and("alignment_applicable").alias("alignment_applicable"),
        F.countDistinct("run").alias("n_runs"),
        *[F.sum(c).alias(c) for c in SUMS],
    )
    return with_rates(pooled).withColumn("dataset_rank", dataset_rank(order))


def _shown(value: str, applicable="alignment_applicable") -> Column:
    text = F.when(F.col(value).isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", F.col(value)))
    return F.when(F.col(applicable), text).otherwise(F.lit("N/A")).alias(value) if applicable else text.alias(value)


def performance_table(pooled: DataFrame, configs=("F", "TB")) -> DataFrame:
    return pooled.filter(F.col("config_id").isin(list(configs))).select(
        "dataset",
        "backend",
        *[_shown(m, None) for m in ("accuracy", "precision", "recall", "f1")],
        *[_shown(r) for r in ("exact_span_match_rate", "mean_token_iou", "recoverable_span_rate")],
    )


def performance_counts(pooled: DataFrame, configs=("F", "TB")) -> DataFrame:
    return pooled.filter(F.col("config_id").isin(list(configs))).select(
        "dataset", "backend", "n_runs", "n_units", "n_correct", "tp", "fp", "fn", "n_pred", "n_rejected"
    )


def alignment_table(pooled: DataFrame, configs=("F", "A5", "B0", "A3")) -> DataFrame:
    return pooled.filter(F.col("config_id").isin(list(configs)) & F.col("alignment_applicable")).select(
        "dataset", "backend", "config_id", *RATES, "precision", "recall", "f1"
    )


def tau_sensitivity(master: DataFrame, config: str = "F", round_: int = 1) -> DataFrame:
    view = master.filter((F.col("config_id") == config) & (F.col("round") == round_))
    sums = view.groupBy("dataset", "backend", "tau").agg(
        *[F.sum(c).alias(c) for c in ("n_units", "n_correct", "tp", "fp", "fn")]
    )
    return sums.select("dataset", "backend", "tau", *[prf_columns()[m].alias(m) for m in ("precision", "recall", "f1")])


def per_label_table(labels: DataFrame, tau: float = PRIMARY_TAU, config: str = "F", round_: int = 1) -> DataFrame:
    view = labels.filter((F.col("tau") == tau) & (F.col("config_id") == config) & (F.col("round") == round_))
    sums = view.groupBy("dataset", "backend", "label").agg(
        *[F.sum(c).alias(c) for c in ("units", "correct", "tp", "fp", "fn")]
    )
    return with_prf(sums, units="units", correct="correct").select(
        "dataset", "backend", "label", label_order("label").alias("label_order"), "units", "accuracy", "precision", "recall", "f1"
    )


def full_metrics_table(pooled: DataFrame) -> DataFrame:
    return pooled.select(
        "dataset", "backend", "config_id", "n_units", "accuracy", "precision", "recall", "f1",
        *[_shown(r) for r in ("exact_span_match_rate", "mean_token_iou", "rejected_span_rate")],
    )


def sort_master(master: DataFrame) -> DataFrame:
    return master.orderBy("dataset", "backend", "config_id", "round", "run", "tau")
