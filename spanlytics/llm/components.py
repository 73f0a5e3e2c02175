"""Connected components of a frame of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlytics.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of the links; the component is its smallest node.

    Each round every node takes the smallest label among itself and its neighbours, then the label of
    that label. Labels fall towards the smallest node; chains shorten by half a round. Minima combine
    before each shuffle, so a node with very many links is no hot key.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).filter("u <> v").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("c").alias("m"))
        low = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        root = labels.select(F.col("node").alias("r"), F.col("c").alias("rc"))
        step = low.join(root, F.col("c") == F.col("r"), "left").select("node", "old", F.least(F.col("c"), F.coalesce("rc", "c")).alias("c"))
        step = written(step, "labels")
        labels = step.select("node", "c")
        if step.filter("c <> old").isEmpty():
            return labels.withColumnRenamed("c", "component")
