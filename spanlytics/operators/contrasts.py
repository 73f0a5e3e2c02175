"""System comparison tables: ablations, dataset contrasts, backends, repeated runs, rounds.

``units`` hold one row per unit and run, or one for all units that the compared runs rate alike (``RecordScores.alike``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlytics.functions.core import prf_columns, ratio
from spanlytics.functions.labels import LABELS
from spanlytics.operators.agreement import ALIKE, inter_run_agreement, stands_for
from spanlytics.operators.significance import (
    COUNTS,
    RESAMPLES,
    SEED,
    bootstrap_contrast,
    deltas,
    holm,
    majority_correct,
    mcnemar,
    pair_systems,
    point_estimates,
    pool_runs,
    resampled_sums,
    summarise,
)
from spanlytics.session import materialize

SYSTEM = ["dataset", "backend", "config_id"]


def _both_metrics(paired: DataFrame, family: list[str], n: int, seeds: tuple[int, int], salt, method) -> DataFrame:
    """F1 and accuracy differences of all families, each metric with its own draws."""
    out = None
    for metric, seed, tag in (("f1", seeds[0], "f1"), ("accuracy", seeds[1], "acc")):
        boot = summarise(deltas(resampled_sums(paired, family, n, seed, salt, method), family, metric), family)
        points = point_estimates(paired, family, metric)
        part = points.join(boot, family).select(
            *family,
            *(["n_reviews"] if out is None else []),
            F.col("value_a").alias(f"{tag}_a"),
            F.col("value_b").alias(f"{tag}_b"),
            F.col("delta").alias(f"delta_{tag}"),
            F.col("ci_low").alias(f"{tag}_ci_low"),
            F.col("ci_high").alias(f"{tag}_ci_high"),
            F.col("p_value").alias(f"p_{tag}"),
        )
        out = part if out is None else out.join(part, family)
    return out


def _full_against(counts: DataFrame, policy: str) -> DataFrame:
    pooled = pool_runs(counts, SYSTEM, policy)
    full = pooled.filter(F.col("config_id") == "F").drop("config_id")
    other = pooled.filter(F.col("config_id") != "F").withColumnRenamed("config_id", "ablation")
    return pair_systems(full, other, ["dataset", "backend"])


def _unit_pairs(units: DataFrame, policy: str) -> DataFrame:
    return majority_correct(units, SYSTEM, policy)


def ablation_main(
    counts: DataFrame, units: DataFrame, n: int = RESAMPLES, seed: int = SEED, policy: str = "pooled", method="poisson"
) -> DataFrame:
    """The full configuration against every other one, per dataset and backend, in one job."""
    family = ["dataset", "backend", "ablation"]
    paired = materialize(_full_against(counts, policy))
    boot = _both_metrics(paired, family, n, (seed, seed + 1), ["dataset"], method)
    sums = paired.groupBy(*family).agg(*[F.sum(s + c).alias(s + c) for s in ("a_", "b_") for c in COUNTS])
    rates = sums.select(
        *family,
        F.col("a_n_units").alias("n_unit_run_pairs"),
        *[
            prf_columns(*[s + c for c in COUNTS])[m].alias(f"{m}_{name}")
            for s, name in (("a_", "full"), ("b_", "ablated"))
            for m in ("precision", "recall")
        ],
    )
    correct = _unit_pairs(units, policy)
    a = correct.filter(F.col("config_id") == "F").select("dataset", "backend", "unit_id", F.col("correct").alias("a"), ALIKE)
    b = correct.filter(F.col("config_id") != "F").select(
        "dataset", "backend", F.col("config_id").alias("ablation"), "unit_id", F.col("correct").alias("b")
    )
    both = a.join(b, ["dataset", "backend", "unit_id"])
    tests = mcnemar(both, family).select(
        *family, F.col("b").alias("mcnemar_b"), F.col("c").alias("mcnemar_c"), F.col("p_exact").alias("p_mcnemar")
    )
    sizes = both.groupBy(*family).agg(F.sum(ALIKE).alias("n_units"))
    table = boot.join(rates, family).join(tests, family).join(sizes, family)
    for p in ("p_f1", "p_acc", "p_mcnemar"):
        table = holm(table, ["dataset", "backend"], p, p.replace("p_", "p_adj_"), tie="ablation")
    return table


def dataset_contrast(
    counts: DataFrame, first: str, second: str, n: int = RESAMPLES, seed: int = SEED, policy="pooled", method="poisson"
) -> DataFrame:
    """Effect of each ablation in one dataset minus its effect in another."""
    paired = _full_against(counts, policy).filter(F.col("dataset").isin(first, second))
    return bootstrap_contrast(
        paired, "dataset", first, second, ["backend", "ablation"], "f1", n, seed + 7, method=method
    ).withColumns({"dataset_1": F.lit(first), "dataset_2": F.lit(second)})


def backend_pairwise(
    counts: DataFrame, units: DataFrame, n: int = RESAMPLES, seed: int = SEED, policy="pooled", method="poisson"
) -> DataFrame:
    """All pairs of backends under the full configuration, Holm-adjusted per dataset."""
    family = ["dataset", "backend_a", "backend_b"]
    full = pool_runs(counts.filter(F.col("config_id") == "F"), SYSTEM, policy).drop("config_id")
    paired = materialize(
        pair_systems(
            full.withColumnRenamed("backend", "backend_a"), full.withColumnRenamed("backend", "backend_b"), ["dataset"]
        ).filter(F.col("backend_a") < F.col("backend_b"))
    )
    boot = summarise(deltas(resampled_sums(paired, family, n, seed + 3, ["dataset"], method), family), family)
    points = point_estimates(paired, family).select(
        *family, F.col("value_a").alias("f1_a"), F.col("value_b").alias("f1_b"), F.col("delta").alias("delta_f1")
    )
    correct = _unit_pairs(units.filter(F.col("config_id") == "F"), policy).drop("config_id")
    left = correct.select("dataset", F.col("backend").alias("backend_a"), "unit_id", F.col("correct").alias("a"), ALIKE)
    right = correct.select("dataset", F.col("backend").alias("backend_b"), "unit_id", F.col("correct").alias("b"))
    both = left.join(right, ["dataset", "unit_id"]).filter(F.col("backend_a") < F.col("backend_b"))
    tests = mcnemar(both, family).select(
        *family, F.col("b").alias("mcnemar_b"), F.col("c").alias("mcnemar_c"), F.col("p_exact").alias("p_mcnemar")
    )
    table = points.join(
        boot.select(*family, "ci_low", "ci_high", F.col("p_value").alias("p_bootstrap")), family
    ).join(tests, family)
    for p in ("p_bootstrap", "p_mcnemar"):
        table = holm(table, ["dataset"], p, p.replace("p_", "p_adj_"), tie="backend_b")
    return table


def multirun_stability(counts: DataFrame, units: DataFrame) -> DataFrame:
    """Mean and sd of accuracy and F1 over runs with the agreement of their unit labels."""
    per_run = counts.groupBy(*SYSTEM, "run").agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumns(prf_columns())
    stats = per_run.groupBy(*SYSTEM).agg(
        F.countDistinct("run").alias("n_runs"),
        F.avg("accuracy").alias("accuracy_mean"),
        F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("accuracy_sd"),
        F.avg("f1").alias("f1_mean"),
        F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("f1_sd"),
    )
    agree = inter_run_agreement(units, SYSTEM).select(
        *SYSTEM,
        F.col("pairwise_agreement").alias("inter_run_agreement"),
        F.col("pairwise_agreement_sd").alias("inter_run_agreement_sd"),
        F.col("fleiss_kappa").alias("inter_run_fleiss_kappa"),
    )
    return stats.join(agree, SYSTEM, "left")


def round_comparison(
    counts: DataFrame, units: DataFrame, n: int = RESAMPLES, seed: int = SEED, policy="pooled", method="poisson"
) -> DataFrame:
    """Second round minus first round with per-label accuracies; ``counts`` hold both rounds."""
    second = pool_runs(counts.filter(F.col("round") == 2), SYSTEM, policy)
    first = pool_runs(counts.filter(F.col("round") == 1), SYSTEM, policy)
    paired = materialize(pair_systems(second, first, SYSTEM))
    boot = _both_metrics(paired, SYSTEM, n, (seed + 11, seed + 12), ["dataset"], method)
    cells = []
    for name in LABELS:
        of = {r: (F.col("round") == r) & (F.col("gold_label") == name) for r in (1, 2)}
        each = stands_for(units)
        acc = {r: ratio(F.sum(F.when(c, F.col("correct") * each)), F.sum(F.when(c, each))) for r, c in of.items()}
        cells += [acc[1].alias(f"{name}_acc_r1"), acc[2].alias(f"{name}_acc_r2"), (acc[2] - acc[1]).alias(f"{name}_delta")]
    return boot.join(units.groupBy(*SYSTEM).agg(*cells), SYSTEM)
