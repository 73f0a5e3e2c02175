"""Rank statistics on distributed data.

Ranks need a running count over all values. Equal values are counted first; the distinct values are
dealt out by range, counted within each range in parallel, and shifted by the totals of the ranges
before. Percentiles are exact order statistics, found by counting in a histogram of the values and
looking closer at the bin that holds the wanted place. No step sorts a whole column in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spanlytics.functions.core import stable_hash
from spanlytics.functions.tails import chi2_sf, normal_p, student_p
from spanlytics.operators.significance import benjamini_hochberg
from spanlytics.session import materialize, task_count

#: Bins of one histogram of the search for an order statistic.
BINS = 256
GREATEST = 1.7976931348623157e308


def cumulative_counts(counted: DataFrame, by: list[str], value: str = "v", n: str = "n") -> DataFrame:
    """Add ``before``: the sum of ``n`` over smaller values within ``by``. One row per (by, value).

    There are as many ranges as tasks of a shuffle. The ranges are written once, so that both readers see the same.
    """
    tasks = task_count(counted.sparkSession)
    placed = materialize(counted.repartitionByRange(tasks, *by, value).withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(n).over(here), F.lit(0)))
    totals = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    return local.join(shift, [*by, "_range"]).withColumn("before", F.col("_local") + F.col("_shift")).drop(
        "_local", "_shift", "_range"
    )


def order_statistics(values: DataFrame, wanted: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """``wanted`` (by, ``place`` from 0, ``lo``, ``hi``, the least and greatest value) with ``value``, the exact order statistic.

    Every pass counts the values between ``lo`` and ``hi`` in equal bins and goes on in the bin that holds
    the place, between its own least and greatest value, until these are one. A task keeps one counter for
    each bin and place, whatever the number of values.
    """
    state, done = materialize(wanted.withColumn("_before", F.lit(0).cast("bigint"))), None
    while True:
        found = state.filter("lo = hi").select(*by, "place", F.col("lo").alias("value"))
        done = found if done is None else done.unionByName(found)
        open_ = state.filter("lo < hi")
        if open_.isEmpty():
            return done
        wide = (F.col("hi") - F.col("lo")) > F.lit(GREATEST)  # a difference beyond the range of doubles is taken in halves
        share = F.when(wide, (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1))
        near = values.join(open_, by) if by else values.join(F.broadcast(open_.withColumn("_all", F.lit(0))), F.lit(0) == F.col("_all")).drop("_all")  # a row for each place
        counted = near.filter("v between lo and hi").groupBy(*by, "place", "_before", bin_.alias("_bin")).agg(
            F.count("*").alias("_n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        up = Window.partitionBy(*by, "place").orderBy("_bin")
        reached = counted.withColumn("_upto", F.col("_before") + F.sum("_n").over(up))
        here = reached.filter((F.col("place") < F.col("_upto")) & (F.col("place") >= F.col("_upto") - F.col("_n")))
        state = materialize(here.select(*by, "place", "lo", "hi", (F.col("_upto") - F.col("_n")).alias("_before")))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles (linear between neighbours) of the values of each group: by, ``share``, ``value``.

    NULL and NaN count as missing, infinite values as the greatest finite ones.
    """
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(GREATEST)), F.lit(-GREATEST))
    values = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, v.alias("v"))
    size = values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("_n > 0")
    size = materialize(size.select("*", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")))
    at = F.col("share") * (F.col("_n") - 1)
    places = size.select("*", F.floor(at).alias("_low"), F.ceil(at).alias("_high"), (at - F.floor(at)).alias("_part"))
    wanted = places.select(*by, F.explode(F.array("_low", "_high")).alias("place"), "lo", "hi").distinct()
    found = order_statistics(values, wanted, by)
    low = found.select(*by, F.col("place").alias("_low"), F.col("value").alias("_v"))
    high = found.select(*by, F.col("place").alias("_high"), F.col("value").alias("_w"))
    both = places.join(low, [*by, "_low"]).join(high, [*by, "_high"])
    return both.select(*by, "share", (F.col("_v") + (F.col("_w") - F.col("_v")) * F.col("_part")).alias("value"))


def ranked_values(df: DataFrame, by: list[str], value: str, extra: dict | None = None) -> DataFrame:
    """Distinct values with their count, average rank and any extra per-value counts."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("n"), *[c.alias(k) for k, c in (extra or {}).items()]
    )
    return cumulative_counts(counted, by).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def winsorize(df: DataFrame, value: str, q: float = 0.99, out: str | None = None) -> DataFrame:
    """Cap at the observed order statistic number ``ceil(q (n - 1))``; adds the cap as ``cap``."""
    values = ranked_values(df, [], value)
    total = values.agg(F.sum("n").alias("_total"))
    place = F.ceil(F.lit(q) * (F.col("_total") - 1)) + 1
    cap = (
        values.withColumn("_one", F.lit(1))
        .join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")  # one row
        .filter((F.col("before") < place) & (F.col("before") + F.col("n") >= place))
        .select("_one", F.col("v").alias("cap"))
    )
    capped = df.withColumn("_one", F.lit(1)).join(F.broadcast(cap), "_one").drop("_one")  # one row
    return capped.withColumn(out or f"{value}_w", F.least(F.col(value).cast("double"), F.col("cap")))


def unpivot(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(*keep, F.inline(rows)).filter(F.col("x").isNotNull())


def mann_whitney(df: DataFrame, by: list[str], value: str, first) -> DataFrame:
    """U of the first group, tie-corrected normal p with continuity correction, rank-biserial.

    ``first`` is a boolean Column marking the first group.
    """
    part = F.coalesce(first, F.lit(False)).cast("int")
    values = ranked_values(df.withColumn("_g", part), by, value, {"n1": F.sum("_g")})
    agg = values.groupBy(*by).agg(
        F.sum("n1").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("n1")).cast("double").alias("n2"),
        F.sum(F.col("n1") * F.col("rank")).alias("r1"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    total = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)
    out = agg.select(
        *by, "n1", "n2", u.alias("U"), z.alias("_z"), (2 * u / F.nullif(n1 * n2, F.lit(0.0)) - 1).alias("rank_biserial")
    )
    return out.withColumn("p", F.least(F.lit(1.0), normal_p("_z"))).drop("_z")


def top_decile_test(df: DataFrame, features: list[str], y: str = "citations", top: float = 0.10) -> DataFrame:
    """Values of each feature in the top citation decile against the rest."""
    cut = percentiles(df, [], y, [1 - top]).select(F.col("value").alias("cut"), F.lit(1).alias("_one"))
    marked = df.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one")  # one row
    rows = unpivot(marked.withColumn("top", F.col(y) >= F.col("cut")), ["top"], features)
    rows = materialize(rows)
    medians = percentiles(rows, ["feature", "top"], "x", [0.5]).groupBy("feature").agg(
        F.max(F.when(F.col("top"), F.col("value"))).alias("median_top"), F.max(F.when(~F.col("top"), F.col("value"))).alias("median_rest")
    )
    tests = mann_whitney(rows, ["feature"], "x", F.col("top"))
    return (
        tests.filter((F.col("n1") >= 2) & (F.col("n2") >= 2))
        .join(medians, "feature")
        .select(
            "feature", F.col("n1").cast("bigint").alias("n_top"), F.col("n2").cast("bigint").alias("n_rest"),
            "median_top", "median_rest", "U", "p", "rank_biserial",
        )
    )


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction and its chi-square p."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v"), group).agg(F.count("*").alias("m"))
    values = cumulative_counts(cells.groupBy("v").agg(F.sum("m").alias("n")), [])
    ties = values.agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"), F.sum("n").cast("double").alias("_total"))
    ranks = values.select("v", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    sums = cells.join(ranks, "v").groupBy(group).agg(F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").alias("m"))
    stat = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k"))
    both = stat.withColumn("_one", F.lit(1)).join(ties.withColumn("_one", F.lit(1)), "_one")
    n = F.col("_total")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("ties") / (F.pow(n, F.lit(3)) - n))
    return both.select(F.col("k"), n.cast("bigint").alias("n"), h.alias("H"), (F.col("k") - 1).cast("double").alias("_df")).withColumn(
        "p", chi2_sf("H", "_df")
    ).drop("_df")


def pairwise_mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs of groups with Benjamini-Hochberg adjusted p-values.

    The pairs are formed from the distinct groups on the cluster, and each row joins those of its group.
    """
    levels = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("a")).distinct()
    pairs = levels.join(levels.select(F.col("a").alias("b")), F.col("a") < F.col("b"))
    mine = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("_own"))
    rows = df.join(mine, F.col(group) == F.col("_own")).select(group, value, "a", "b")
    tests = mann_whitney(rows, ["a", "b"], value, F.col(group) == F.col("a"))
    tagged = tests.withColumns({"_all": F.lit(0), "_tie": F.concat_ws("|", "a", "b")})
    return benjamini_hochberg(tagged, ["_all"], "p", "p_bh", tie="_tie").select("a", "b", "U", "p", "p_bh")


def _rank_correlation(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Pearson correlation of average ranks of (x, y) rows; ``weight`` counts repeated rows."""
    w = F.col(weight) if weight else F.lit(1)
    cells = rows.groupBy(*by, "x", "y").agg(F.sum(w).cast("double").alias("w")).filter(F.col("w") > 0)

    def side(c):
        counts = cells.groupBy(*by, F.col(c).alias("v")).agg(F.sum("w").alias("n"))
        return cumulative_counts(counts, by).select(
            *by, F.col("v").alias(c), (F.col("before") + (F.col("n") + 1) / 2).alias("r" + c)
        )

    joined = cells.join(side("x"), [*by, "x"]).join(side("y"), [*by, "y"])
    mean = (F.sum("w") + 1) / 2
    rx, ry, ww = F.col("rx"), F.col("ry"), F.col("w")
    sums = joined.groupBy(*by).agg(
        F.sum("w").alias("n"),
        (F.sum(ww * rx * ry) - F.sum("w") * mean * mean).alias("sxy"),
        (F.sum(ww * rx * rx) - F.sum("w") * mean * mean).alias("sxx"),
        (F.sum(ww * ry * ry) - F.sum("w") * mean * mean).alias("syy"),
    )
    return sums.select(
        *by, F.col("n"), F.try_divide("sxy", F.sqrt(F.greatest(F.lit(0.0), F.col("sxx") * F.col("syy")))).alias("rho")
    )


def spearman(df: DataFrame, features: list[str], y: str = "citations", n_boot: int = 0, key: str | None = None, seed: int = 0) -> DataFrame:
    """Rank correlation of each feature with ``y``, t-based p, and a bootstrap interval.

    Resampling gives each row a Poisson(1) weight per resample from a stable hash of ``key``.
    """
    from spanlytics.operators.significance import POISSON_CDF

    rows = unpivot(df, [F.col(y).cast("double").alias("y"), *([key] if key else [])], features)
    base = _rank_correlation(rows, ["feature"])
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    out = base.select("feature", F.col("n").cast("bigint").alias("n"), "rho", F.abs(t).alias("_t"), (F.col("n") - 2).alias("_df"))
    out = out.withColumn("p", student_p("_t", "_df")).drop("_t", "_df")
    if not n_boot:
        return out
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).select(
        "feature", "x", "y", "b",
        F.explode(F.array(stable_hash(F.lit(seed), "b", key) / F.lit(float(1 << 32)))).alias("u"),
    )
    weight = sum((F.col("u") >= F.lit(c)).cast("int") for c in POISSON_CDF)
    boots = _rank_correlation(drawn.withColumn("w", weight).filter(F.col("w") > 0), ["feature", "b"], "w")
    ci = boots.groupBy("feature").agg(
        F.percentile("rho", F.lit(0.025)).alias("ci_low"), F.percentile("rho", F.lit(0.975)).alias("ci_high"), F.count("rho").alias("B")
    )
    return out.join(ci, "feature")
