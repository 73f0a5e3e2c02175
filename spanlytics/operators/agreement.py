"""Agreement of raters and repeated runs. All work is on counts, so no unit list is collected.

A row of units may stand for many of equal ratings (``alike``, see ``RecordScores.alike``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanlytics.functions.core import ratio
from spanlytics.functions.labels import NONE

#: Column that says for how many units of equal ratings a row stands; without it a row is one.
ALIKE = "alike"


def stands_for(df: DataFrame) -> Column:
    return F.col(ALIKE) if ALIKE in df.columns else F.lit(1).cast("bigint")


def cohen_kappa(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """po, pe and kappa per group; kappa is 1 when chance agreement is complete."""
    if not by:
        return cohen_kappa(df.withColumn("_all", F.lit(0)), a, b, ["_all"]).drop("_all")
    cells = df.groupBy(*by, F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(
        F.sum(stands_for(df)).alias("n")
    )
    total = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same")
    )
    sides = cells.select(
        *by, F.inline(F.array(F.struct(F.col("x").alias("lab"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")),
                              F.struct(F.col("y").alias("lab"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"))))
    )
    product = (
        sides.groupBy(*by, "lab")
        .agg(F.sum("na").cast("double").alias("na"), F.sum("nb").cast("double").alias("nb"))
        .groupBy(*by)
        .agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    )
    both = total.join(product, list(by))
    po = ratio("same", "n")
    pe = F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return both.select(
        *by,
        "n",
        po.alias("agreement"),
        pe.alias("chance"),
        F.when(pe < 1, F.try_divide(po - pe, 1 - pe)).otherwise(1.0).alias("kappa"),
    )


def fleiss_kappa(df: DataFrame, unit: str, category: str, by: list[str] = ()) -> DataFrame:
    """``df`` holds one row per rating (of a unit, or of units that are ``alike``). Unequal numbers of ratings per unit are an error."""
    if not by:
        return fleiss_kappa(df.withColumn("_all", F.lit(0)), unit, category, ["_all"]).drop("_all")
    cell = df.groupBy(*by, unit, F.col(category).alias("_cat")).agg(F.count("*").cast("double").alias("n"), F.max(stands_for(df)).alias("_w"))
    per_unit = cell.groupBy(*by, unit).agg(F.sum("n").alias("_k"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.max("_w").alias("_w"))
    raters = F.max("_k")
    same = (F.col("sq") - F.col("_k")) / F.nullif(F.col("_k") * (F.col("_k") - 1), F.lit(0.0))
    mean = per_unit.groupBy(*by).agg(
        F.sum("_w").alias("n_units"),
        F.min("_k").alias("k_min"),
        raters.alias("_k"),
        (F.sum(same * F.col("_w")) / F.sum(F.when(same.isNotNull(), F.col("_w")))).alias("p_bar"),
    )
    shares = (
        cell.groupBy(*by, "_cat")
        .agg(F.sum(F.col("n") * F.col("_w")).alias("n"))
        .groupBy(*by)
        .agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("p_e"))
    )
    both = mean.join(shares, list(by))
    value = F.when(F.col("p_e") < 1, F.try_divide(F.col("p_bar") - F.col("p_e"), 1 - F.col("p_e"))).otherwise(1.0)
    return both.select(
        *by,
        "n_units",
        F.when(F.col("k_min") != F.col("_k"), F.raise_error(F.lit("units have different numbers of ratings")).cast("double"))
        .otherwise(value)
        .alias("fleiss_kappa"),
    )


def icc_oneway(df: DataFrame, subject: str, value: str, by: list[str] = ()) -> DataFrame:
    """ICC(1,1) from one row per rating with equally many ratings per subject."""
    per = df.groupBy(*by, subject).agg(
        F.count(value).cast("double").alias("_k"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )
    total = per.groupBy(*by).agg(
        F.count("*").alias("n_subjects"), F.max("_k").alias("_k"), F.var_samp("m").alias("vm"), F.avg("v").alias("msw")
    )
    msb = F.col("_k") * F.col("vm")
    icc = F.try_divide(msb - F.col("msw"), msb + (F.col("_k") - 1) * F.col("msw"))
    return total.select(*by, "n_subjects", msb.alias("msb"), "msw", icc.alias("icc"))


def inter_run_agreement(units: DataFrame, by: list[str]) -> DataFrame:
    """Pairwise agreement, mean Cohen kappa and Fleiss kappa of unit labels over runs.

    Units that were never predicted count with the label ``None``.
    """
    filled = units.select(*by, "unit_id", "run", F.coalesce("pred_label", F.lit(NONE)).alias("label"), stands_for(units).alias(ALIKE))
    left = filled.select(*by, "unit_id", F.col("run").alias("run_a"), F.col("label").alias("la"), ALIKE)
    right = filled.select(*by, "unit_id", F.col("run").alias("run_b"), F.col("label").alias("lb"))
    # runs of one unit are few, so the self-join stays linear in the units
    paired = left.join(right, [*by, "unit_id"]).filter(F.col("run_a") < F.col("run_b"))
    per_pair = cohen_kappa(paired, "la", "lb", [*by, "run_a", "run_b"])
    pairwise = per_pair.groupBy(*by).agg(
        F.avg("agreement").alias("pairwise_agreement"),
        F.coalesce(F.stddev_samp("agreement"), F.lit(0.0)).alias("pairwise_agreement_sd"),
        F.avg("kappa").alias("pairwise_cohen_kappa"),
        F.max("n").alias("n_units"),
    )
    fleiss = fleiss_kappa(filled, "unit_id", "label", by).drop("n_units")
    runs = filled.groupBy(*by).agg(F.countDistinct("run").alias("n_runs"))
    return pairwise.join(fleiss, by).join(runs, by)
