"""Paired resampling over reviews, McNemar, Holm, Benjamini-Hochberg, one-way ANOVA."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spanlytics.functions.core import col, count_if, prf_columns, stable_hash
from spanlytics.functions.tails import binom_half_cdf, binom_half_pmf, chi2_sf, f_sf
from spanlytics.operators.agreement import ALIKE, stands_for
from spanlytics.session import materialize, task_count

COUNTS = ["n_units", "n_correct", "tp", "fp", "fn"]
RESAMPLES = 10_000
SEED = 12345
CONFIDENCE = 0.95
# Distribution function of the Poisson(1) law at 0, 1, 2, ...
POISSON_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
]
# Modulus and summands of the draws, and the thresholds of a weight of 1, 2, 3, ...
PRIME = 2147483647
STRIDE = 1103515245
SUMMANDS = (12345, 67890, 1013904223)
THRESHOLDS = [int(c * PRIME) for c in POISSON_CDF]
#: Resamples whose weights are held at once, and reviews of one such block.
B_BLOCK, REVIEW_BLOCK = 500, 250


def pool_runs(counts: DataFrame, by: list[str], policy: str = "pooled") -> DataFrame:
    """Per-review counts summed over runs, or those of the first run (``policy='run0'``)."""
    if policy == "run0":
        first = counts.groupBy(*by).agg(F.min("run").alias("run"))
        counts = counts.join(first, [*by, "run"])
    return counts.groupBy(*by, "review_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def pair_systems(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Reviews present in both systems with ``a_*`` and ``b_*`` counts."""
    a = left.select(*[c for c in left.columns if c not in COUNTS], *[F.col(c).alias("a_" + c) for c in COUNTS])
    b = right.select(*[c for c in right.columns if c not in COUNTS], *[F.col(c).alias("b_" + c) for c in COUNTS])
    return a.join(b, [*on, "review_id"])


def _metric(side: str, metric: str) -> Column:
    return prf_columns(*[f"{side}_{c}" for c in COUNTS])[metric]


def _sums() -> list[Column]:
    return [F.sum(s + c).alias(s + c) for s in ("a_", "b_") for c in COUNTS]


def _modulo(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^63 modulo the Mersenne prime, but for the prime itself, which stands for 0."""
    x = (x & PRIME) + (x >> 31)
    return (x & PRIME) + (x >> 31)


def weights(keys: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of reviews (rows) in resamples (columns), from three squarings modulo a prime."""
    x = _modulo(keys[:, None] + b[None, :] * STRIDE)
    for c in SUMMANDS:
        x = _modulo(x * x + c)
    x[x == PRIME] = 0
    x = x.astype(np.int32)
    out = np.zeros(x.shape, np.int8)
    for t in THRESHOLDS:
        out += x >= np.int32(t)
    return out


def _block_sums(family: list[str], columns: list[str], n: int):
    """Per family and block of resamples: count matrix times weight matrix, summed over the rows of a task.

    The rows of all families of a block of reviews are one matrix, so its weights are made and read once.
    """

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = {f: batch.schema.field(f).type for f in family}
            names = list(zip(*[batch.column(f).to_pylist() for f in family]))
            kinds_of = list(dict.fromkeys(names))
            number = {k: i for i, k in enumerate(kinds_of)}
            which = np.array([number[k] for k in names])
            keys, place = np.unique(batch.column("_key").to_numpy(), return_inverse=True)
            counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            # reviews of the same families lie together, so that a block has few families
            lead = np.full(len(keys), len(number))
            np.minimum.at(lead, place, which)
            sorted_ = np.argsort(lead, kind="stable")
            place = np.argsort(sorted_, kind="stable")[place]
            keys, by_place = keys[sorted_], np.argsort(place, kind="stable")
            edges = np.searchsorted(place[by_place], np.arange(0, len(keys) + REVIEW_BLOCK, REVIEW_BLOCK))
            for first, lo_row, hi_row in zip(range(0, len(keys), REVIEW_BLOCK), edges[:-1], edges[1:]):
                rows = by_place[lo_row:hi_row]
                own = keys[first : first + REVIEW_BLOCK]
                there, slot = np.unique(which[rows], return_inverse=True)
                matrix = np.zeros((len(there), len(columns), len(own)))
                np.add.at(matrix, (slot, slice(None), place[rows] - first), counts[:, rows].T)
                flat = matrix.reshape(-1, len(own))
                for lo in range(0, n, B_BLOCK):
                    part = (flat @ weights(own, np.arange(lo, min(lo + B_BLOCK, n))).astype(float)).reshape(len(there), len(columns), -1)
                    for i, f in enumerate(there.tolist()):
                        k = kinds_of[f]
                        if (k, lo) in total:
                            total[k, lo] += part[i]
                        else:
                            total[k, lo] = part[i].copy()
        if total:
            found = list(total)
            arrays = [pa.array([k[i] for k, _ in found], kinds[f]) for i, f in enumerate(family)]
            sums = [np.rint(total[x]).astype(np.int64).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([lo for _, lo in found], pa.int32()), pa.array(sums, pa.binary())], names=[*family, "lo", "sums"])

    return run


def _merged_sums(family: list[str], columns: list[str]):
    """The blocks of all tasks added up; a row for each family and resample."""

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = {f: batch.schema.field(f).type for f in family}
            names = zip(*[batch.column(f).to_pylist() for f in family])
            for k, lo, data in zip(names, batch.column("lo").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(data, np.int64).reshape(len(columns), -1)
                total[k, lo] = total[k, lo] + part if (k, lo) in total else part
        for (k, lo), sums in total.items():
            n = sums.shape[1]
            arrays = [pa.array([k[i]] * n, kinds[f]) for i, f in enumerate(family)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(lo, lo + n, dtype=np.int32)), *map(pa.array, sums)], names=[*family, "b", *columns])

    return run


def resampled_sums(
    paired: DataFrame, family: list[str], n: int = RESAMPLES, seed: int = SEED, salt: list[str] = (), method: str = "poisson"
) -> DataFrame:
    """Count sums of ``n`` resamples of the reviews of each family: family, b, a_*, b_*.

    ``poisson`` gives every review an independent Poisson(1) weight per resample, the usual form for data
    too large to index. The weights of a block of reviews form a matrix that is multiplied with the matrix
    of their counts, so no row is repeated for a resample; a task sends one sum for each family and block
    of resamples. ``multinomial`` draws R reviews with replacement: slot hashes point at review numbers and
    an equi-join fetches the counts. The method does not depend on the size of the data.
    Draws depend on seed, salt, resample and review (or slot), so equal families share draws.
    """
    if method == "poisson":
        columns = [s + c for s in ("a_", "b_") for c in COUNTS]
        rows = paired.select(*family, *[F.col(c).cast("bigint") for c in columns], (stable_hash(F.lit(seed), *salt, "review_id") % PRIME).alias("_key"))
        kinds = ", ".join(f"{f} {paired.schema[f].dataType.simpleString()}" for f in family)
        tasks = task_count(paired.sparkSession)
        parts = rows.repartition(tasks, "_key").mapInArrow(_block_sums(family, columns, n), f"{kinds}, lo int, sums binary")
        dealt = parts.repartition(tasks, *family, "lo")
        return dealt.mapInArrow(_merged_sums(family, columns), f"{kinds}, b int, {', '.join(c + ' bigint' for c in columns)}")
    paired = materialize(paired)
    numbered = paired.withColumn(
        "idx", F.row_number().over(Window.partitionBy(*family).orderBy("review_id")).cast("bigint") - 1
    )
    size = paired.groupBy(*family).agg(F.count("*").alias("R"))
    spread = paired.sparkSession.sparkContext.defaultParallelism
    slots = (
        size.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
        .repartition(spread, *family, "b")
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("R") - 1)).alias("slot"))
        .select(*family, "b", (stable_hash(F.lit(seed), *salt, "b", "slot") % F.col("R")).alias("idx"))
    )
    return slots.join(numbered.drop("review_id"), [*family, "idx"]).groupBy(*family, "b").agg(*_sums())


def deltas(sums: DataFrame, family: list[str], metric: str = "f1") -> DataFrame:
    return sums.select(*family, "b", (_metric("a", metric) - _metric("b", metric)).alias("delta")).filter(
        F.col("delta").isNotNull()
    )


def summarise(resampled: DataFrame, family: list[str], confidence: float = CONFIDENCE, value: str = "delta") -> DataFrame:
    """Percentile interval, two-sided p-value, mean and sd of resampled differences."""
    tail = (1 - confidence) / 2
    d = F.col(value)
    agg = resampled.groupBy(*family).agg(
        F.count(d).alias("n_resamples"),
        F.percentile(d, F.lit(tail)).alias("ci_low"),
        F.percentile(d, F.lit(1 - tail)).alias("ci_high"),
        count_if(d <= 0).alias("_le"),
        count_if(d >= 0).alias("_ge"),
        F.avg(d).alias("boot_mean"),
        F.stddev_samp(d).alias("boot_sd"),
    )
    low = (F.col("_le") + 1) / (F.col("n_resamples") + 1)
    high = (F.col("_ge") + 1) / (F.col("n_resamples") + 1)
    return agg.withColumn("p_value", F.least(F.lit(1.0), 2 * F.least(low, high))).drop("_le", "_ge")


def point_estimates(paired: DataFrame, family: list[str], metric: str = "f1") -> DataFrame:
    total = paired.groupBy(*family).agg(F.count("*").alias("n_reviews"), *_sums())
    return total.select(
        *family,
        "n_reviews",
        _metric("a", metric).alias("value_a"),
        _metric("b", metric).alias("value_b"),
        (_metric("a", metric) - _metric("b", metric)).alias("delta"),
    )


def paired_bootstrap(
    paired: DataFrame,
    family: list[str],
    metric: str = "f1",
    n: int = RESAMPLES,
    seed: int = SEED,
    salt: list[str] = (),
    confidence: float = CONFIDENCE,
    method: str = "poisson",
) -> DataFrame:
    """One row per family: both values, difference, interval and p-value."""
    sums = resampled_sums(paired, family, n, seed, salt, method)
    return point_estimates(paired, family, metric).join(
        summarise(deltas(sums, family, metric), family, confidence), family
    )


def bootstrap_contrast(
    paired: DataFrame,
    split: str,
    first: str,
    second: str,
    by: list[str],
    metric: str = "f1",
    n: int = RESAMPLES,
    seed: int = SEED,
    confidence: float = CONFIDENCE,
    method: str = "poisson",
) -> DataFrame:
    """Difference of two differences, e.g. between datasets, with independent draws in each."""
    family = [split, *by]
    each = deltas(resampled_sums(paired, family, n, seed, [split], method), family, metric)
    points = point_estimates(paired, family, metric)

    def of(df, value, name, keys):
        return df.filter(F.col(split) == value).select(*keys, F.col("delta").alias(name))

    joined = of(each, first, "d1", [*by, "b"]).join(of(each, second, "d2", [*by, "b"]), [*by, "b"])
    spread = summarise(joined.withColumn("contrast", F.col("d1") - F.col("d2")), by, confidence, "contrast")
    both = of(points, first, "delta_1", by).join(of(points, second, "delta_2", by), by)
    return both.withColumn("contrast", F.col("delta_1") - F.col("delta_2")).join(
        spread.select(*by, "ci_low", "ci_high", "p_value"), by
    )


def majority_correct(units: DataFrame, by: list[str], policy: str = "pooled") -> DataFrame:
    """One correctness value per distinct unit (or per kind of units that are ``alike``): at least half of the runs, or the first run."""
    if policy == "run0":
        first = units.groupBy(*by).agg(F.min("run").alias("run"))
        return units.join(first, [*by, "run"]).select(*by, "unit_id", "correct", stands_for(units).alias(ALIKE))
    return units.groupBy(*by, "unit_id").agg((F.avg("correct") >= 0.5).cast("int").alias("correct"), F.max(stands_for(units)).alias(ALIKE))


def mcnemar(paired: DataFrame, family: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Discordant counts with exact, mid-p and continuity-corrected chi-square p-values."""
    yes_a, yes_b, each = F.col(a) == 1, F.col(b) == 1, stands_for(paired)
    total = lambda cond: F.sum(F.when(cond, each).otherwise(0))
    counts = paired.groupBy(*family).agg(
        total(yes_a & ~yes_b).alias("b"), total(~yes_a & yes_b).alias("c"), F.sum(each).alias("n_paired")
    )
    n = F.col("b") + F.col("c")
    k = F.least("b", "c")
    chi2 = F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)), n.cast("double"))
    prepared = counts.withColumns({"n_discordant": n, "_k": k.cast("double"), "_n": n.cast("double")}).withColumns(
        {
            "chi2_cc": F.when(n > 0, chi2).otherwise(F.lit(0.0)),
            "_cdf": binom_half_cdf("_k", "_n"),
            "_pmf": binom_half_pmf("_k", "_n"),
        }
    )
    none = F.col("n_discordant") == 0
    return prepared.select(
        *family,
        "b",
        "c",
        "n_discordant",
        F.when(none, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("_cdf"))).alias("p_exact"),
        F.when(none, 1.0).otherwise(F.least(F.lit(1.0), 2 * (F.col("_cdf") - F.col("_pmf") / 2))).alias("p_midp"),
        "chi2_cc",
        F.when(none, 1.0).otherwise(chi2_sf("chi2_cc", F.lit(1.0))).alias("p_chi2_cc"),
    )


def holm(df: DataFrame, family: list[str], p: str, out: str, tie: str | None = None) -> DataFrame:
    """Step-down adjusted p-values within each family of tests; NULL counts as 1."""
    order = [F.coalesce(F.col(p), F.lit(1.0)), *([F.col(tie)] if tie else [])]
    ranked = Window.partitionBy(*family).orderBy(*order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = (size - F.row_number().over(ranked) + 1) * order[0]
    raised = df.withColumn("_step", step)
    running = F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return raised.withColumn(out, F.least(F.lit(1.0), running)).drop("_step")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, out: str, tie: str | None = None) -> DataFrame:
    order = [F.col(p), *([F.col(tie)] if tie else [])]
    up = Window.partitionBy(*family).orderBy(*order)
    down = Window.partitionBy(*family).orderBy(*[o.desc() for o in order])
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = df.withColumn("_q", F.col(p) * size / F.row_number().over(up))
    running = F.min("_q").over(down.rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn(out, F.least(F.lit(1.0), running)).drop("_q")


def anova_oneway(df: DataFrame, group: str, value: str, by: list[str] = ()) -> DataFrame:
    """F and p; NULL for fewer than two groups or a group with fewer than two values."""
    v = col(value).cast("double")
    groups = df.filter(v.isNotNull()).groupBy(*by, group).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("v")
    )
    n, m = F.col("n"), F.col("m")
    total = groups.groupBy(*by).agg(
        F.count("*").alias("k"),
        F.min("n").alias("least"),
        F.sum("n").alias("_total"),
        F.sum(n * F.col("v")).alias("ssw"),
        (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum("n")).alias("ssb"),
    )
    fine = (F.col("k") >= 2) & (F.col("least") >= 2)
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("_total") - F.col("k")).cast("double")
    f = F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2)
    out = total.select(*by, F.when(fine, f).alias("F"), d1.alias("df1"), d2.alias("df2"))
    return out.withColumn("p", f_sf("F", "df1", "df2"))


def mean_sd(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n")
    )
