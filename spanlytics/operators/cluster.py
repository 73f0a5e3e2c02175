"""K-means profiles: number of clusters by silhouette, sizes, means."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F


def kmeans_assign(df: DataFrame, features: list[str], k_range=range(2, 7), n_init: int = 20, seed: int = 0):
    """(assigned rows, {k: silhouette}). The silhouette is the linear-time squared-distance form."""
    rows = df.dropna(subset=features)
    vectors = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(vectors).transform(vectors)
    n = scaled.count()
    judge = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster")
    scores, best = {}, None
    for k in k_range:
        if k >= n:
            continue
        fits = [KMeans(k=k, seed=seed + i, featuresCol="_x", predictionCol="cluster").fit(scaled) for i in range(n_init)]
        model = min(fits, key=lambda m: m.summary.trainingCost)
        scores[k] = judge.evaluate(model.transform(scaled))
        if best is None or scores[k] > best[0]:
            best = (scores[k], model)
    if best is None:
        return None, {}
    return best[1].transform(scaled).drop("_raw", "_x"), scores


def cluster_profiles(assigned: DataFrame, features: list[str]) -> DataFrame:
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("size"), *[F.bround(F.avg(f), 4).alias(f) for f in features]
    )
