"""Article-level features from span counts, and citation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanlytics.functions.core import col, count_if, ratio
from spanlytics.functions.labels import LABELS, RECOVERED

CORE = ["r_substan", "r_neg_val", "r_jus", "T"]
EXTENDED = [*CORE, "r_crit", "r_neg_jus"]
FULL = [*EXTENDED, "b_pos", "c_MC"]
HORIZON_YEARS = 10


def span_counts(spans: DataFrame, by: list[str]) -> DataFrame:
    """Recovered spans with a legal label, one column per label."""
    legal = spans.filter(F.col("status").isin(RECOVERED) & F.col("label").isin(LABELS))
    return legal.groupBy(*by).agg(*[count_if(F.col("label") == lab).alias(f"n_{lab}") for lab in LABELS])


def article_counts(spans: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts per article; spans of unknown reviews drop out of the join."""
    known = spans.join(meta.select("review_id", "article_id"), "review_id")
    return span_counts(known, ["article_id"])


def feature_columns() -> dict[str, Column]:
    ep, en, jp, jn, mc = (F.col(f"n_{lab}") for lab in LABELS)
    evals, jus = ep + en, jp + jn
    total = evals + jus + mc
    return {
        "r_substan": ratio(jus, evals + jus),
        "r_neg_val": ratio(en, evals),
        "r_jus": ratio(jus, total),
        "T": total,
        "r_crit": ratio(en, total),
        "r_neg_jus": ratio(jn, jus),
        "b_pos": ratio(ep, en + 1),
        "c_MC": mc,
    }


def article_features(counts: DataFrame) -> DataFrame:
    """The eight ratios; counts are summed per article before ratios are formed."""
    return counts.withColumns(feature_columns())


def window_complete(year, retrieved_year, years) -> Column:
    """A citation window is complete inside the horizon, or when the observed years reach back."""
    year, years = col(year), col(years)
    inside = year >= col(retrieved_year) - (HORIZON_YEARS - 1)
    return F.coalesce(inside | F.coalesce(F.array_min(years) <= year, F.lit(False)), F.lit(False))


def window_citations(df: DataFrame, window: int = 5, counts: str = "counts_by_year") -> DataFrame:
    """Add ``complete`` and ``citations`` (NULL when the window is incomplete).

    Needs publication_year, retrieved_year and ``array<struct<year, cited_by_count>>``.
    """
    year = F.col("publication_year")
    listed = F.coalesce(F.col(counts), F.array().cast("array<struct<year:int,cited_by_count:bigint>>"))
    inside = F.filter(listed, lambda c: (c["year"] >= year) & (c["year"] < year + window))
    total = F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, c: a + c["cited_by_count"])
    complete = window_complete("publication_year", "retrieved_year", F.transform(listed, lambda c: c["year"]))
    return df.withColumns({"complete": complete, "citations": F.when(complete, total)})


def join_citations(features: DataFrame, citations: DataFrame) -> DataFrame:
    """Left join by lower-cased doi."""
    right = citations.select(F.lower("doi").alias("_doi"), "citations")
    return features.withColumn("_doi", F.lower("doi")).join(right, "_doi", "left").drop("_doi")


def analysis_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["citations", "year"]).withColumn("year", F.col("year").cast("int"))


def dispersion(df: DataFrame, value: str = "citations", by: list[str] = ()) -> DataFrame:
    v = F.col(value).cast("double")
    agg = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))
    return agg.withColumn("variance_to_mean", F.try_divide("variance", "mean"))


def feature_correlations(df: DataFrame, features=tuple(FULL), digits: int = 3) -> DataFrame:
    """Pairwise-complete Pearson correlations, all pairs in one aggregate, as long rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    cells = df.agg(
        *[
            F.corr(
                F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
            ).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.bround(F.col(f"`{a}|{b}`"), digits).alias("r")) for a, b in pairs]
    )
    return cells.select(F.inline(rows))
