"""Line dedup by site-relative frequency.

A line is boilerplate on a site when it stands on at least ``min_pages`` of its pages and on more
than ``ratio`` of them. Counting works on (site, hash of the trimmed line): every page counts a line
once, partial counts combine before the shuffle, so one very common line or one very large site is no
hot key. A line needs more than ``ratio`` of the pages, so a site has at most (mean lines of a page /
ratio) such lines, however many pages it has: they fit in one small row for each site.

Defined results: a null text stays null; blank lines never count and never go; pages with a null site
form one site of their own; repeated rows are pages of their own; an empty table stays empty; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanlytics.functions.core import let
from spanlytics.llm.common import BROADCAST_BYTES, fresh, query, read, written

RATIO = 0.05
MIN_PAGES = 5
BLANK = " \t\r"


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANK)))


def _is_text(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(BLANK))) > 0


def site_lines(df: DataFrame, text: str, site: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each site with boilerplate: ``site, line_keys``."""
    pages = df.select(F.coalesce(site, F.lit("")).alias("site"), F.split(F.col(text), "\n").alias("lines"))
    keys = F.array_distinct(F.transform(F.filter("lines", _is_text), line_key))
    # key null counts the page itself, so one pass gives totals and line counts
    each = pages.select("site", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(keys, F.array().cast("array<long>")))).alias("key"))
    counts = each.groupBy("site", "key").agg(F.count("*").alias("n")).filter(F.col("key").isNull() | (F.col("n") >= min_pages))
    counts = written(counts, "line-counts")
    totals = counts.filter("key is null").select("site", F.col("n").alias("pages"))
    often = counts.filter("key is not null").join(totals, "site").filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.sort_array(F.collect_list("key")).alias("line_keys"))


def drop_site_lines(df: DataFrame, text: str, site: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None) -> DataFrame:
    """``df`` with the boilerplate lines of each site cut out of ``text``; ``dropped`` names a count."""
    own_site, own_keys, own_lines = fresh(df, "line_site", "line_keys", "line_parts")
    bad = written(site_lines(df, text, site, ratio, min_pages), "site-lines").select(F.col("site").alias(own_site), F.col("line_keys").alias(own_keys))
    size = bad.agg(F.coalesce(F.sum(F.size(own_keys) * 8 + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    marked = df.withColumn(own_site, F.coalesce(site, F.lit(""))).join(bad, own_site, "left")

    def kept(keys):
        return F.filter(F.split(F.col(text), "\n"), lambda x: ~(_is_text(x) & F.array_contains(keys, line_key(x))))

    cut = F.when(F.col(own_keys).isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept(F.col(own_keys)), "\n"))
    if dropped:
        n = F.when(F.col(own_keys).isNotNull() & F.col(text).isNotNull(), F.size(F.split(F.col(text), "\n")) - F.size(kept(F.col(own_keys)))).otherwise(0)
        marked = marked.withColumn(dropped, n.cast("long"))
    return marked.withColumn(text, cut).select(*df.columns, *([dropped] if dropped else []))


# ------------------------------------------------------------------ pages

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BLOCKS = r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|hr|pre|blockquote)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def page_host(url) -> Column:
    return F.lower(F.regexp_extract(F.col(url), HOST, 1))


def page_lines(html) -> Column:
    """Text of a page, one block a line, blank lines left out."""
    out = F.regexp_replace(F.col(html), UNSEEN, "")
    out = F.regexp_replace(F.regexp_replace(out, BLOCKS, "\n"), TAGS, "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return let(F.transform(F.split(out, "\n"), lambda x: F.trim(x, F.lit(BLANK))), lambda a: F.array_join(F.filter(a, lambda x: F.length(x) > 0), "\n"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _page_sql() -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace(html, {_quoted(UNSEEN)}, '', 'g'), {_quoted(BLOCKS)}, chr(10), 'g'), {_quoted(TAGS)}, '', 'g')"
    for entity, char in ENTITIES:
        out = f"replace({out}, {_quoted(entity)}, {_quoted(char)})"
    blank = "' ' || chr(9) || chr(13)"
    return f"""with p as (select row_number() over () rid, page_id, lower(regexp_extract(url, {_quoted(HOST)}, 1)) site,
  list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x, {blank})), lambda x: x <> '') ls from pages),
tot as (select site, count(*) pages from p group by site),
often as (select site, l, count(*) n from (select site, unnest(list_distinct(ls)) l from p) group by all),
bad as (select o.site, list(l) bl from often o join tot t using (site) where n >= {MIN_PAGES} and n > {RATIO} * pages group by o.site),
k as (select p.page_id, p.site, ls, case when bl is null then ls else list_filter(ls, lambda x: not list_contains(bl, x)) end kept
  from p left join bad b on b.site = p.site)
select page_id, site, len(ls)::bigint n_lines, (len(ls) - len(kept))::bigint n_dropped, md5(array_to_string(kept, chr(10))) kept_md5 from k"""


@query("op2_line_dedup", _page_sql())
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page, and what is left of it without the boilerplate of its host."""
    pages = read(spark, sf_dir, "pages").select("page_id", page_host("url").alias("site"), page_lines("html").alias("text"))
    pages = written(pages, "page-lines")
    n_lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long")
    out = drop_site_lines(pages.withColumn("n_lines", n_lines), "text", F.col("site"), dropped="n_dropped")
    return out.select("page_id", "site", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
