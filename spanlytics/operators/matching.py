"""Overlap pairs of predicted and gold spans, and exact one-to-one greedy matching.

Ranges are token ranges ``[ts, tj)``. Two spans that share a token share a block of the token
line, so pairs come from an equi-join on (review, block) instead of all pairs of a review; a pair
is kept only in the block holding its first shared token, so it appears once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanlytics.functions.labels import LABELS, is_recovered
from spanlytics.functions.tokens import overlap, token_iou
from spanlytics.session import materialize

RUN_KEYS = ["backend", "config_id", "run", "round"]
KEYS = ["dataset", *RUN_KEYS]
BLOCK = 64
#: Tokens of a stretch of one review in which a task sweeps.
STRETCH = 4096


def _with_blocks(df: DataFrame, ts: str, tj: str, block: int) -> DataFrame:
    first, last = F.expr(f"{ts} div {block}"), F.expr(f"({tj} - 1) div {block}")
    return df.withColumn("block", F.explode(F.sequence(first, last)))


def overlap_pairs(pred: DataFrame, gold: DataFrame, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """Recovered prediction x gold span pairs of one review that share at least one token."""
    p = pred.filter(is_recovered("status", "start", "end") & (F.col("tj") > F.col("ts"))).select(
        *keys,
        "review_id",
        "p_idx",
        F.col("label").alias("p_label"),
        F.col("ts").alias("p_ts"),
        F.col("tj").alias("p_tj"),
        F.col("start").alias("p_start"),
        F.col("end").alias("p_end"),
    )
    g = gold.filter(F.col("tj") > F.col("ts")).select(
        "review_id",
        "g_idx",
        F.col("label").alias("g_label"),
        F.col("ts").alias("g_ts"),
        F.col("tj").alias("g_tj"),
        F.col("start").alias("g_start"),
        F.col("end").alias("g_end"),
    )
    joined = _with_blocks(p, "p_ts", "p_tj", block).join(
        _with_blocks(g, "g_ts", "g_tj", block), ["review_id", "block"]
    )
    shared = overlap("p_ts", "p_tj", "g_ts", "g_tj")
    home = F.expr(f"greatest(p_ts, g_ts) div {block}")
    return joined.filter((shared > 0) & (F.col("block") == home)).select(
        *keys,
        "review_id",
        "p_idx",
        "g_idx",
        "p_label",
        "g_label",
        shared.alias("overlap"),
        token_iou("p_ts", "p_tj", "g_ts", "g_tj").alias("iou"),
        F.least("p_ts", "g_ts").alias("lo"),
        F.greatest("p_tj", "g_tj").alias("hi"),
        (
            (F.col("p_label") == F.col("g_label"))
            & (F.col("p_start") == F.col("g_start"))
            & (F.col("p_end") == F.col("g_end"))
        ).alias("exact"),
    )


def same_label(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.col("p_label") == F.col("g_label")) & F.col("g_label").isin(LABELS))


def _fold(ordered: Column) -> Column:
    """Walk pairs in rank order and keep those whose two ends are both still free."""
    start = F.struct(
        F.expr("cast(array() as array<bigint>)").alias("p"),
        F.expr("cast(array() as array<bigint>)").alias("g"),
        F.expr("cast(array() as array<struct<iou:double,p_idx:bigint,g_idx:bigint>>)").alias("kept"),
    )

    def step(acc, pair):
        taken = F.array_contains(acc["p"], pair["p_idx"]) | F.array_contains(acc["g"], pair["g_idx"])
        picked = F.struct((-pair["neg_iou"]).alias("iou"), pair["p_idx"], pair["g_idx"])
        return F.when(taken, acc).otherwise(
            F.struct(
                F.array_append(acc["p"], pair["p_idx"]).alias("p"),
                F.array_append(acc["g"], pair["g_idx"]).alias("g"),
                F.array_append(acc["kept"], picked).alias("kept"),
            )
        )

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def _entry(*more: str) -> Column:
    """A pair as an element of a list in rank order."""
    return F.struct(
        (-F.col("iou")).alias("neg_iou"),
        F.col("p_idx").cast("bigint").alias("p_idx"),
        F.col("g_idx").cast("bigint").alias("g_idx"),
        *more,
    )


def match_small_groups(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Greedy matching by one ordered fold per group; for groups known to be small, such as components."""
    folded = pairs.groupBy(*group).agg(_fold(F.sort_array(F.collect_list(_entry()))).alias("kept"))
    return folded.select(*group, F.inline("kept"))


def match_by_rounds(pairs: DataFrame, group: list[str]) -> DataFrame:
    """The same matching without collecting a group: rounds of mutually best pairs.

    A pair that ranks first for both of its ends is always part of the greedy result, so taking
    all such pairs, dropping the pairs they touch and repeating ends in the greedy matching. The
    two minima per round aggregate before they shuffle, so a hot span or review stays spread out.
    """
    rank = F.struct((-F.col("iou")).alias("neg_iou"), "p_idx", "g_idx")
    columns = [*group, "iou", "p_idx", "g_idx"]
    rest = materialize(
        pairs.select(*group, "iou", F.col("p_idx").cast("bigint"), F.col("g_idx").cast("bigint")).select(*columns)
    )
    kept = None
    while not rest.isEmpty():
        best_p = rest.groupBy(*group, "p_idx").agg(F.min(rank).alias("best")).select(*group, "best")
        best_g = rest.groupBy(*group, "g_idx").agg(F.min(rank).alias("best")).select(*group, "best")
        mutual = materialize(
            best_p.join(best_g, [*group, "best"]).select(
                *group, (-F.col("best.neg_iou")).alias("iou"), "best.p_idx", "best.g_idx"
            )
        )
        kept = mutual if kept is None else kept.unionByName(mutual)
        rest = materialize(
            rest.join(mutual.select(*group, "p_idx"), [*group, "p_idx"], "left_anti")
            .join(mutual.select(*group, "g_idx"), [*group, "g_idx"], "left_anti")
            .select(*columns)
        )
    return pairs.sparkSession.createDataFrame([], pairs.select(*columns).schema) if kept is None else kept


def overlap_components(pairs: DataFrame, group: list[str], stretch: int = STRETCH) -> DataFrame:
    """``pairs`` with ``component``: pairs of different components of a group share no span.

    A sweep over the token line: pairs that share a span overlap, so a component ends where a pair begins
    at or behind the greatest end so far. The line is cut into stretches; the greatest end and the last
    beginning of a component are carried from stretch to stretch, so a long review is swept by many tasks.
    """
    rows = pairs.withColumn("_s", F.expr(f"cast(lo div {stretch} as int)"))
    before = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*group, "_s").agg(F.max("hi").alias("_hi"))
    carry = ends.select(*group, "_s", F.coalesce(F.max("_hi").over(before), F.lit(-1)).alias("_reach"))
    inside = Window.partitionBy(*group, "_s").orderBy("lo", "hi", "p_idx", "g_idx")
    earlier = F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    swept = rows.join(carry, [*group, "_s"]).withColumn("_reach", F.greatest("_reach", F.coalesce(earlier, F.lit(-1))))
    swept = swept.withColumn("_begin", F.when(F.col("lo") >= F.col("_reach"), F.col("lo")))
    begun = swept.groupBy(*group, "_s").agg(F.max("_begin").alias("_last"))
    carry = begun.select(*group, "_s", F.max("_last").over(before).alias("_open"))
    own = F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return swept.join(carry, [*group, "_s"]).withColumn("component", F.coalesce(own, "_open")).drop("_s", "_reach", "_begin", "_open")


def greedy_match(pairs: DataFrame, keys=KEYS, stretch: int = STRETCH) -> DataFrame:
    """One-to-one matches, taken by (iou desc, prediction index, gold index) per run, review, label.

    The order is by IoU first, so the matching at a threshold tau is the part of this result with
    ``iou >= tau``: one matching serves a whole grid of thresholds. Pairs of different overlap components
    cannot get in each other's way, so each component is folded by itself, however large its review is.

    Pairs are dealt once, by group and stretch of the token line. A component that lies in one stretch is
    folded where it is; the few that reach over the end of a stretch are taken out and put together.
    """
    group = [*keys, "review_id", "g_label"]
    rows = same_label(pairs).select(*group, "lo", "hi", "iou", "p_idx", "g_idx").withColumn("_s", F.expr(f"cast(lo div {stretch} as int)"))
    later = F.explode(F.expr(f"sequence(_s + 1, cast((hi - 1) div {stretch} as int))"))
    over = rows.filter(F.col("hi") > (F.col("_s") + 1) * stretch).select(*group, later.alias("_s"), "hi")
    over = over.groupBy(*group, "_s").agg(F.max("hi").alias("_reach"))
    line = Window.partitionBy(*group, "_s").orderBy("lo", "hi", "p_idx", "g_idx")
    earlier = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    swept = rows.join(over, [*group, "_s"], "left").withColumn("_reach", F.greatest(F.coalesce("_reach", F.lit(-1)), F.coalesce(earlier, F.lit(-1))))
    swept = swept.withColumn("_begin", F.max(F.when(F.col("lo") >= F.col("_reach"), F.col("lo"))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # only the last component of a stretch can reach over its end, and only the first lacks a beginning in it
    whole = Window.partitionBy(*group, "_s")
    last = F.max("_begin").over(whole).eqNullSafe(F.col("_begin")) & (F.max("hi").over(whole) > (F.col("_s") + 1) * stretch)
    swept = swept.withColumn("_edge", F.col("_begin").isNull() | last)
    held = swept.groupBy(*group, "_s", "_begin", "_edge").agg(F.sort_array(F.collect_list(_entry("lo", "hi"))).alias("_pairs"))
    none = F.lit(None).cast("int")
    kept = F.transform(_fold(F.col("_pairs")), lambda k: F.struct(k["iou"], k["p_idx"], k["g_idx"], none.alias("lo"), none.alias("hi")))
    raw = F.transform("_pairs", lambda k: F.struct((-k["neg_iou"]).alias("iou"), k["p_idx"], k["g_idx"], k["lo"].cast("int").alias("lo"), k["hi"].cast("int").alias("hi")))
    done = materialize(held.select(*group, "_edge", F.inline(F.when(F.col("_edge"), raw).otherwise(kept))))
    inner = done.filter(~F.col("_edge")).select(*group, "iou", "p_idx", "g_idx")
    edge = overlap_components(done.filter("_edge").drop("_edge"), group, stretch)
    return inner.unionByName(match_small_groups(edge, [*group, "component"]).drop("component"))
