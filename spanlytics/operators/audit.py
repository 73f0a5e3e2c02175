"""Numeric audit: every reported number must follow from its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlytics.functions.core import prf_columns, ratio0, with_prf

METRICS = ["accuracy", "precision", "recall", "f1"]
COUNTS = ["n_units", "n_correct", "tp", "fp", "fn"]
REQUIRED = [*COUNTS, *METRICS]


def missing_columns(master: DataFrame) -> list[str]:
    return sorted(set(REQUIRED) - set(master.columns))


def audit_findings(master: DataFrame, tol: float = 1e-6) -> DataFrame:
    """level, location, message; identical findings of several thresholds appear once.

    One OK row states the number of rows when there is no error.
    """
    gone = missing_columns(master)
    if gone:
        return master.sparkSession.createDataFrame(
            [("ERROR", "columns", f"master table lacks {gone}")], "level string, location string, message string"
        )
    fresh = prf_columns()
    where = F.concat_ws(" / ", *[F.col(c).cast("string") for c in ("dataset", "backend", "config_id", "run") if c in master.columns])
    six = lambda c: F.format_string("%.6f", c)

    def finding(cond, level, message):
        return F.when(cond, F.struct(F.lit(level).alias("level"), message.alias("message")))

    checks = []
    for m in METRICS:
        reported, counted = F.col(m), fresh[m]
        off = F.abs(counted - reported) > tol
        text = F.concat(F.lit(f"{m} reported "), six(reported), F.lit(" but counts give "), six(counted))
        checks.append(finding(off | (counted.isNull() != reported.isNull()), "ERROR", text))
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("f1")
    identity = ratio0(2 * p * r, p + r)
    checks.append(
        finding(
            F.abs(identity - f1) > tol, "ERROR", F.concat(F.lit("F1 "), six(f1), F.lit(" != 2PR/(P+R) "), six(identity))
        )
    )
    equal = (F.abs(F.col("accuracy") - r) < 1e-9) & (F.col("n_units") > 0)
    built_in = (F.col("tp") == F.col("n_correct")) & (F.col("tp") + F.col("fn") == F.col("n_units"))
    checks.append(finding(equal & built_in, "INFO", F.lit("Accuracy equals Recall by construction: TP = N_correct and TP + FN = N")))
    checks.append(
        finding(equal & ~built_in, "WARN", F.lit("Accuracy equals Recall numerically but not structurally; verify the counts."))
    )
    found = (
        master.select(where.alias("location"), F.explode(F.array_compact(F.array(*checks))).alias("f"))
        .select("f.level", "location", "f.message")
        .distinct()
    )
    # one aggregate over the table decides about the OK row
    bad = None
    for m in METRICS:
        one = F.coalesce(F.abs(fresh[m] - F.col(m)) > tol, fresh[m].isNull() != F.col(m).isNull())
        bad = one if bad is None else bad | one
    bad = bad | (F.abs(identity - f1) > tol)
    ok = (
        master.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))
        .filter(~F.col("bad"))
        .select(
            F.lit("OK").alias("level"),
            F.lit("master").alias("location"),
            F.format_string("%d rows: all P/R/F1/Accuracy values are consistent with their counts", F.col("n")).alias("message"),
        )
    )
    return found.unionByName(ok)


def pooled_vs_mean(master: DataFrame, by=("backend", "config_id", "run", "round", "tau")) -> DataFrame:
    """Pooled micro metrics against the mean of the dataset rows, for groups over several datasets."""
    real = master.filter(F.col("dataset") != "pooled")
    pooled = real.groupBy(*by).agg(
        F.countDistinct("dataset").alias("_d"),
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.avg(m).alias(f"{m}_mean_of_datasets") for m in METRICS],
    )
    fresh = prf_columns()
    cols = []
    for m in METRICS:
        cols += [
            fresh[m].alias(f"{m}_pooled"),
            F.col(f"{m}_mean_of_datasets"),
            (fresh[m] - F.col(f"{m}_mean_of_datasets")).alias(f"{m}_diff"),
        ]
    return pooled.filter(F.col("_d") >= 2).select(*by, *cols)


def reported_view(master: DataFrame, tau: float, round_: int = 1) -> DataFrame:
    """One threshold and round, counts pooled over runs, metrics from the pooled counts."""
    view = master.filter((F.col("tau") == tau) & (F.col("round") == round_))
    return with_prf(
        view.groupBy("dataset", "backend", "config_id").agg(
            F.countDistinct("run").alias("n_runs"), *[F.sum(c).alias(c) for c in COUNTS]
        )
    )


def nearest_tau(master: DataFrame, target: float = 0.5) -> float:
    """The threshold in the table closest to ``target``: one number."""
    row = master.agg(F.min_by("tau", F.struct(F.abs(F.col("tau") - target), "tau")).alias("t")).first()
    return row["t"]


def table_crosscheck(
    master: DataFrame, published: DataFrame, keys=("dataset", "backend", "config_id"), tol: float = 5e-5,
    tau: float | None = None, round_: int = 1,
) -> DataFrame:
    """Published numbers against the reported view; one row per published metric."""
    if "tau" in master.columns:
        master = reported_view(master, nearest_tau(master) if tau is None else tau, round_)
    metrics = [m for m in METRICS if m in published.columns]
    ours = master.select(*keys, *[F.col(m).alias(f"{m}_master") for m in metrics])
    joined = ours.join(published.select(*keys, *metrics), list(keys))
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_master").alias("master"), F.col(m).alias("published")) for m in metrics]
    )
    return (
        joined.select(*keys, F.inline(rows))
        .filter(F.col("published").isNotNull() & F.col("master").isNotNull())
        .withColumn("abs_diff", F.abs(F.col("master") - F.col("published")))
        .withColumn("ok", F.col("abs_diff") <= tol)
    )
