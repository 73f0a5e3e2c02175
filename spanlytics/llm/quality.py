"""Quality rules with adaptive thresholds.

Every document gets counts (words, symbols, repeated lines, repeated word windows) inside its row, with
built-in functions only. Four ratios of these counts go into quantile sketches for each language and
source: a sketch counts values in buckets of geometric width (relative error ``ERROR``), so two
sketches merge by adding counts, partial sketches combine before the shuffle, and sketches of a
language or of everything are sums of those of the sources. The cut-offs of a group are fences far
outside its middle half; groups with fewer than ``MIN_DOCS`` documents use their language, then all
documents. A document is kept when no ratio lies outside the fences it is joined with.

Defined results: a null or empty text has no words and fails the base rule; null languages and sources
are groups of their own; repeated rows are measured and judged alike; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanlytics.functions.core import let
from spanlytics.llm.common import BROADCAST_BYTES, fresh, query, read, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
MIN_DOCS = 50
#: Width of the fences in spreads (median to quartile), and the least distance from the median.
SPREADS = 8.0
# metric -> (numerator, denominator, least distance, two-sided)
METRICS = {
    "word_length": ("word_chars", "n_words", 1.0, True),
    "symbols": ("n_symbols", "n_words", 0.2, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.3, False),
    "repeats": ("n_repeat_words", "n_words", 0.2, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs at least twice; windows start at every word."""

    def starts(s):
        same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def total(at):
        steps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(starts(s), total)))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts and ``n_lines`` (lines with a word)."""
    body, words, hashes, lines = fresh(df, "quality_text", "quality_words", "quality_hashes", "quality_lines")
    size = lambda c: F.size(c).cast("long")
    out = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns(
        {
            words: F.regexp_extract_all(F.col(body), F.lit(WORD), F.lit(0)),
            lines: F.filter(F.split(F.col(body), "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0),
        }
    )
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col(words), i, WINDOW)))
    out = out.withColumn(hashes, F.when(F.size(words) >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    return out.withColumns(
        {
            "n_words": size(words),
            "word_chars": F.length(F.translate(F.col(body), BLANKS, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(F.col(body), SYMBOLS, ""))).cast("long"),
            "n_dup_lines": size(lines) - size(F.array_distinct(lines)),
            "n_lines": size(lines),
            "n_repeat_words": _covered(F.col(hashes)),
        }
    ).drop(body, words, hashes, lines)


def _ratio(num: str, den: str) -> Column:
    return F.coalesce(F.try_divide(F.col(num).cast("double"), F.col(den)), F.lit(0.0))


def sketches(df: DataFrame, lang: str, source: str) -> DataFrame:
    """``lang, source, metric, bucket, n``; a null bucket counts zeros."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), _ratio(a, b).alias("x")) for m, (a, b, _, _) in METRICS.items()])
    rows = df.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.explode(each).alias("m"))
    bucket = F.when(F.col("m.x") > 0, F.ceil(F.log(F.col("m.x")) / math.log(GAMMA)))
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, docs, q1, q2, q3`` of sketches merged over everything but ``keys``."""
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    cum = merged.withColumns({"upto": F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first())), "docs": F.sum("n").over(group)})
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1), F.lit(0.0))
    at = {f"q{i}": F.min(F.when(F.col("upto") * 4 >= F.col("docs") * i, value)) for i in (1, 2, 3)}
    return cum.groupBy(*keys, "docs").agg(*[v.alias(k) for k, v in at.items()])


def fences(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and for each metric its lowest and highest accepted value."""
    names = ["docs", "q1", "q2", "q3"]

    def level(keys, tag):
        return quantiles(sketch, keys).select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in names])

    rows = level(["lang", "source", "metric"], "s").join(level(["lang", "metric"], "l"), ["lang", "metric"]).join(level(["metric"], "a"), "metric")
    enough = [(F.col("docs_s") >= MIN_DOCS, "s"), (F.col("docs_l") >= MIN_DOCS, "l")]
    pick = lambda q: F.when(enough[0][0], F.col(f"{q}_s")).when(enough[1][0], F.col(f"{q}_l")).otherwise(F.col(f"{q}_a"))
    rows = rows.select("lang", "source", "metric", *[pick(q).alias(q) for q in names[1:]])
    out = []
    for m, (_, _, least, two) in METRICS.items():
        own = F.col("metric") == m
        high = F.max(F.when(own, F.col("q2") + F.greatest(F.lit(least), SPREADS * (F.col("q3") - F.col("q2")))))
        low = F.max(F.when(own, F.col("q2") - F.greatest(F.lit(least), SPREADS * (F.col("q2") - F.col("q1")))))
        out += [high.alias(f"{m}_high"), (low if two else F.lit(-1.0)).alias(f"{m}_low")]
    return rows.groupBy("lang", "source").agg(*out)


def judged(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``."""
    limits = written(fences(written(sketches(df, lang, source), "sketches")), "fences")
    own_lang, own_source, *own = fresh(df, "fence_lang", "fence_source", *[c for c in limits.columns if c not in ("lang", "source")])
    names = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.col("lang").alias(own_lang), F.col("source").alias(own_source), *[F.col(a).alias(b) for a, b in zip(names, own)])
    if limits.count() * 256 <= BROADCAST_BYTES:
        limits = F.broadcast(limits)
    at = dict(zip(names, own))
    rows = df.join(limits, (F.coalesce(df[lang], F.lit("")) == F.col(own_lang)) & (F.coalesce(df[source], F.lit("")) == F.col(own_source)), "left")
    inside = F.lit(True)
    for m, (num, den, _, _) in METRICS.items():
        inside = inside & (_ratio(num, den) <= F.col(at[f"{m}_high"])) & (_ratio(num, den) >= F.col(at[f"{m}_low"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & inside}).drop(own_lang, own_source, *own)


def _sql() -> str:
    ratios = " union all ".join(f"select lang, source, '{m}' metric, coalesce({a}::double / nullif({b}, 0), 0) x from base" for m, (a, b, _, _) in METRICS.items())

    def level(keys, tag):
        k = ", ".join(keys)
        return f"""{tag}0 as (select {k}, bucket, sum(n) n from sk group by {k}, bucket),
{tag}1 as (select *, sum(n) over (partition by {k} order by bucket nulls first) upto, sum(n) over (partition by {k}) docs from {tag}0),
{tag} as (select {k}, docs, {", ".join(f"min(case when upto * 4 >= docs * {i} then coalesce(2 * pow({GAMMA!r}::double, bucket) / {GAMMA + 1!r}::double, 0) end) q{i}" for i in (1, 2, 3))} from {tag}1 group by {k}, docs)"""

    pick = lambda q: f"case when s.docs >= {MIN_DOCS} then s.{q} when l.docs >= {MIN_DOCS} then l.{q} else a.{q} end {q}"
    fence, inside = [], []
    for m, (a, b, least, two) in METRICS.items():
        fence.append(f"max(case when metric = '{m}' then q2 + greatest({least}::double, {SPREADS}::double * (q3 - q2)) end) {m}_high")
        fence.append(f"max(case when metric = '{m}' then q2 - greatest({least}::double, {SPREADS}::double * (q2 - q1)) end) {m}_low" if two else f"-1.0::double {m}_low")
        x = f"coalesce({a}::double / nullif({b}, 0), 0)"
        inside.append(f"{x} <= {m}_high and {x} >= {m}_low")
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""with t as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') x from documents),
w as (select *, regexp_extract_all(x, '{WORD}') ws, list_filter(string_split(x, chr(10)), lambda l: trim(l, {blanks}) <> '') ls from t),
win as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') g from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 2}))) i from w)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) c from win) where c > 1),
cov as (select doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::bigint n from (select *, lead(i) over (partition by doc_id order by i) nxt from rep) group by doc_id),
base as (select w.doc_id, lang, source, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::bigint word_chars,
  (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, len(ls)::bigint n_lines,
  coalesce(cov.n, 0) n_repeat_words from w left join cov using (doc_id)),
r as ({ratios}),
sk as (select lang, source, metric, case when x > 0 then ceil(ln(x) / {math.log(GAMMA)!r}::double)::integer end bucket, count(*) n from r group by all),
{level(["lang", "source", "metric"], "s")},
{level(["lang", "metric"], "l")},
{level(["metric"], "a")},
q as (select s.lang, s.source, s.metric, {", ".join(map(pick, ("q1", "q2", "q3")))} from s join l on s.lang = l.lang and s.metric = l.metric join a on s.metric = a.metric),
f as (select lang, source, {", ".join(fence)} from q group by lang, source),
j as (select b.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words base_failed, {" and ".join(inside)} ok from base b join f on b.lang = f.lang and b.source = f.source)
select doc_id, {", ".join(COUNTS)}, base_failed, not base_failed and ok kept from j"""


@query("op1_quality_rules", _sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = read(spark, sf_dir, "documents")
    base = measured(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return judged(written(base, "measured")).select("doc_id", *COUNTS, "base_failed", "kept")
