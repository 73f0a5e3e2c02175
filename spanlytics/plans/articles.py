"""Queries on reviewer sections, article features, citations and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlytics.functions.core import stable_hash
from spanlytics.operators import cluster as K
from spanlytics.operators import features as FE
from spanlytics.operators import ranks as RK
from spanlytics.operators import regress as RG
from spanlytics.plans import derived as D
from spanlytics.plans.derived_sql import h
from spanlytics.plans.registry import query, r6, rounded
from spanlytics.plans.statistics import chi2_sf_sql, normal_two_sided_sql, student_two_sided_sql
from spanlytics.session import materialize
from spanlytics.sources import articles as AR

# ----------------------------------------------------------------------- pages and sections


@query(
    "page_paragraphs",
    r"""with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) title,
      regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1) ps from pages),
    u as (select page_id, title, unnest(ps) raw, generate_subscripts(ps, 1) - 1 para_idx from t)
    select page_id, title, para_idx, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) "text" from u
    where trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) <> ''""",
)
def page_paragraphs(spark, sf):
    return AR.page_paragraphs(D.table(spark, sf, "pages"))


TYPES = ["decision-letter", "referee-report", "reply", "decision-letter", "evaluation-summary"]


def _paragraphs(spark, sf):
    """Lines of the documents as paragraphs of sub-articles of eight lines; some open with a reviewer header."""
    letter = lambda i: (stable_hash(F.lit("ty"), "article_id", i) % 5).isin(0, 3)
    parts = D.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.split("text", "\n").alias("parts"))
    subs = F.sequence(F.lit(0).cast("long"), F.floor((F.size("parts") - 1) / 8))
    # once for each article: which sub-articles are letters
    lines = parts.select("article_id", F.transform(subs, letter).alias("are_letters"), F.posexplode("parts").alias("line", "body"))
    rows = lines.select("article_id", F.expr("line div 8").alias("sub_idx"), F.expr("line % 8").alias("para_idx"), "body", "are_letters")
    kind = stable_hash(F.lit("ty"), "article_id", "sub_idx") % 5
    head = stable_hash(F.lit("hd"), "article_id", "sub_idx", "para_idx")
    who = (head % 3 + 1).cast("string")
    text = (
        F.when(head % 7 == 0, F.concat(F.lit("Reviewer #"), who, F.lit(":")))
        .when(head % 7 == 1, F.concat(F.lit("Reviewer "), who, F.lit(" (notes): "), F.col("body")))
        .when(head % 7 == 2, F.concat(F.lit("Thank you for submitting "), F.col("body")))
        .otherwise(F.col("body"))
    )
    letters = F.size(F.filter(F.slice("are_letters", F.lit(1), (F.col("sub_idx") + 1).cast("int")), lambda x: x))
    return rows.select(
        "article_id", "sub_idx", letters.alias("letters"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (kind + 1).cast("int")).alias("type"),
        F.concat(F.lit("S"), F.col("sub_idx").cast("string")).alias("sub_id"), "para_idx", text.alias("text"),
    )


SECTIONS = f"""lines as (select doc_id article_id, unnest(string_split(text, chr(10))) body, generate_subscripts(string_split(text, chr(10)), 1) - 1 line from documents),
sub as (select article_id, line // 8 sub_idx, line % 8 para_idx, body,
  ['decision-letter','referee-report','reply','decision-letter','evaluation-summary'][{h("'ty'", 'article_id', 'line // 8')} % 5 + 1] "type",
  {h("'hd'", 'article_id', 'line // 8', 'line % 8')} hd from lines),
kept as (select *, hd % 3 + 1 who from sub where "type" <> 'reply'),
letters as (select article_id, sub_idx, sum(case when any_value("type") = 'decision-letter' then 1 else 0 end) over (partition by article_id order by sub_idx) rounds
  from kept group by article_id, sub_idx),
named as (select k.*, greatest(1, rounds)::int round,
  case when hd % 7 = 0 then who::varchar when hd % 7 = 1 and trim(body) <> '' then who::varchar end hdr,
  case when hd % 7 = 0 then null when hd % 7 = 1 then trim(body) else body end bd
  from kept k join letters using (article_id, sub_idx) where hd % 7 <> 2),
placed as (select *, coalesce(last_value(hdr ignore nulls) over (partition by article_id, sub_idx order by para_idx rows unbounded preceding),
  case when "type" = 'decision-letter' then 'editor-consolidated' else "type" || ':S' || sub_idx end) reviewer from named),
sect as (select article_id, sub_idx, "type", round, reviewer, min(para_idx) first_para, count(*) n_paragraphs, string_agg(bd, chr(10) order by para_idx) txt
  from placed where bd is not null and trim(bd) <> '' group by all)"""


@query("reviewer_sections", f"with {SECTIONS} select article_id, sub_idx, \"type\", round, reviewer, n_paragraphs, sha256(txt) text_sha from sect")
def reviewer_sections(spark, sf):
    s = AR.reviewer_sections(_paragraphs(spark, sf))
    return s.select("article_id", "sub_idx", "type", "round", "reviewer", "n_paragraphs", F.sha2("text", 256).alias("text_sha"))


@query(
    "section_rollup",
    f"""with {SECTIONS} select 'art-' || article_id review_id, count(*) n_reports, array_to_string(list_sort(list_distinct(list(round))), ',') rounds,
      sha256(string_agg('[Round ' || round || ' – ' || case when reviewer = 'editor-consolidated' then 'Consolidated decision letter' else 'Reviewer ' || reviewer end || ']' || chr(10) || txt,
        chr(10) || chr(10) order by sub_idx, first_para)) text_sha from sect group by article_id""",
)
def section_rollup(spark, sf):
    a = AR.article_records(AR.reviewer_sections(_paragraphs(spark, sf)), "art")
    return a.select("review_id", "n_reports", "rounds", F.sha2("text", 256).alias("text_sha"))


@query(
    "gold_attach",
    """select doc_id review_id, d.lang, length(d.text) n_chars, d.doc_id % 2 = 1 text_differs from documents d join labels l using (doc_id)""",
)
def gold_attach(spark, sf):
    """Documents with gold of the labelled reviews; half of the extracted texts differ from the gold text."""
    docs = D.table(spark, sf, "documents")
    records = docs.select(
        F.col("doc_id").alias("review_id"), "lang", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text")
    )
    rated = D.table(spark, sf, "labels").select("doc_id")
    gold = docs.join(rated, "doc_id", "left_semi").select(F.col("doc_id").alias("review_id"), "text", F.array().alias("spans"))
    out = AR.attach_gold(records, gold)
    return out.select("review_id", "lang", F.length("text").alias("n_chars"), "text_differs")


# ----------------------------------------------------------------------- features and citations

# Which event type stands for which label.
EVENT_LABEL = {"purchase": "Eval_pos", "error": "Eval_neg", "view": "Jus_pos", "click": "Jus_neg", "signup": "Major_Claim"}

COUNTS = "cnt as (select user_id, " + ", ".join(f"count(*) filter (event_type = '{e}') \"n_{lab}\"" for e, lab in EVENT_LABEL.items()) + " from events group by user_id)"
FEATURES = """feat as (select user_id, ep, en, jp, jn, mc, (jp + jn)::double / nullif(ep + en + jp + jn, 0) r_substan, en::double / nullif(ep + en, 0) r_neg_val,
  (jp + jn)::double / nullif(ep + en + jp + jn + mc, 0) r_jus, ep + en + jp + jn + mc "T", en::double / nullif(ep + en + jp + jn + mc, 0) r_crit,
  jn::double / nullif(jp + jn, 0) r_neg_jus, ep::double / (en + 1) b_pos, mc "c_MC"
  from (select user_id, "n_Eval_pos" ep, "n_Eval_neg" en, "n_Jus_pos" jp, "n_Jus_neg" jn, "n_Major_Claim" mc from cnt))"""
CITED = """yr as (select o_custkey, year(o_orderdate) y, count(*) c from orders group by all),
cite as (select o_custkey, min(y) publication_year, min(y) first_seen from yr group by o_custkey),
win as (select c.o_custkey, publication_year, {retrieved} retrieved_year,
  publication_year >= {retrieved} - 9 complete, coalesce(sum(yr.c) filter (yr.y >= publication_year and yr.y < publication_year + 5), 0)::bigint total
  from cite c join yr using (o_custkey) group by all)"""


def _event_spans(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in EVENT_LABEL.items() for x in kv])
    return D.table(spark, sf, "events").select(
        F.col("user_id").alias("review_id"), m[F.col("event_type")].alias("label"), F.lit("exact").alias("status")
    )


def _features(spark, sf):
    spans = _event_spans(spark, sf)
    meta = spans.select("review_id", F.col("review_id").alias("article_id")).distinct()
    return FE.article_features(FE.article_counts(spans, meta))


def _citations(spark, sf, retrieved):
    o = D.table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("c"))
    works = o.groupBy("o_custkey").agg(
        F.min("y").alias("publication_year"),
        F.collect_list(F.struct(F.col("y").alias("year"), F.col("c").alias("cited_by_count"))).alias("counts_by_year"),
    )
    return FE.window_citations(works.withColumn("retrieved_year", retrieved))


def _analysis(spark, sf):
    """Article rows: features by user joined with five-year counts of the orders of the same number."""
    cites = _citations(spark, sf, F.lit(2004)).select(
        F.concat(F.lit("10.1/A"), F.col("o_custkey").cast("string")).alias("doi"), "citations",
        F.col("publication_year").alias("pub"), F.col("o_custkey"),
    )
    feats = _features(spark, sf).withColumn("doi", F.concat(F.lit("10.1/a"), F.col("article_id").cast("string")))
    joined = FE.join_citations(feats, cites)
    years = cites.select(F.lower("doi").alias("doi"), F.col("pub").alias("year"))
    return FE.analysis_rows(joined.join(years, "doi", "left"))


ANALYSIS = f"with {COUNTS}, {FEATURES}, {CITED.format(retrieved='2004')}, an as materialized (select f.*, w.total citations, w.publication_year y from feat f join win w on w.o_custkey = f.user_id where complete)"


@query(
    "article_features",
    f"with {COUNTS}, {FEATURES} select user_id article_id, {', '.join(r6(f) + ' ' + f for f in ('r_substan', 'r_neg_val', 'r_jus', 'r_crit', 'r_neg_jus', 'b_pos'))}, \"T\", \"c_MC\" from feat",
)
def article_features(spark, sf):
    return rounded(_features(spark, sf).select("article_id", *FE.FULL))


@query(
    "citation_window",
    f"with {CITED.format(retrieved='2006 - (c.o_custkey % 3)::int')} select o_custkey, publication_year, retrieved_year, true complete, total citations from win",
)
def citation_window(spark, sf):
    """Years are listed from the first one on, so they always reach back to the publication year."""
    w = _citations(spark, sf, (F.lit(2006) - F.col("o_custkey") % 3).cast("int"))
    return w.select("o_custkey", "publication_year", "retrieved_year", "complete", "citations")


@query(
    "citation_window_gaps",
    """with yr as (select o_custkey, year(o_orderdate) y, count(*) c from orders group by all), k as (select *, (1993 + o_custkey % 4)::int pub from yr),
      g as (select o_custkey, pub, min(y) lo, sum(c) filter (y >= pub and y < pub + 5) s from k group by all)
      select o_custkey, pub publication_year, pub >= 1995 or lo <= pub complete, case when pub >= 1995 or lo <= pub then coalesce(s, 0)::bigint end citations from g""",
)
def citation_window_gaps(spark, sf):
    o = D.table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("c"))
    works = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("y").alias("year"), F.col("c").alias("cited_by_count"))).alias("counts_by_year"))
    works = works.withColumns({"publication_year": (1993 + F.col("o_custkey") % 4).cast("int"), "retrieved_year": F.lit(2004)})
    return FE.window_citations(works).select("o_custkey", "publication_year", "complete", "citations")


@query(
    "winsorized",
    ANALYSIS + f", c as (select list_sort(list(citations))[ceil(0.9::double * (count(*) - 1))::int + 1] cap from an) select user_id article_id, least(citations, cap)::double citations_w, cap::double cap from an, c",
)
def winsorized(spark, sf):
    rows = _analysis(spark, sf).select("article_id", "citations")
    return RK.winsorize(rows, "citations", 0.9).select("article_id", "citations_w", "cap")


@query("dispersion", ANALYSIS + f" select count(citations) n, {r6('avg(citations)')} mean, {r6('var_samp(citations)')} variance, {r6('var_samp(citations) / avg(citations)')} variance_to_mean from an")
def dispersion(spark, sf):
    return rounded(FE.dispersion(_analysis(spark, sf)))


_PAIRS = " union all ".join(
    f"select '{a}' a, '{b}' b, round_even(corr(\"{a}\", \"{b}\"), 3) r from an" for i, a in enumerate(FE.FULL) for b in FE.FULL[i:]
)


@query("feature_corr", ANALYSIS + " " + _PAIRS)
def feature_corr(spark, sf):
    return FE.feature_correlations(_analysis(spark, sf))


def _long(features) -> str:
    return " union all ".join(f"select '{f}' feature, \"{f}\"::double x, citations::double yy from an where \"{f}\" is not null" for f in features)


AVGRANK = "(rank() over (partition by feature order by {c}) + (count(*) over (partition by feature, {c}) - 1) / 2.0)"


@query(
    "spearman_matrix",
    ANALYSIS
    + f""", l as ({_long(FE.CORE)}), r as (select feature, {AVGRANK.format(c='x')} rx, {AVGRANK.format(c='yy')} ry from l),
    s as (select feature, count(*) n, corr(rx, ry) rho from r group by feature), t as (select *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) t from s)
    select feature, n, {r6('rho')} rho, {r6(student_two_sided_sql('t', '(n - 2)'))} p from t""",
)
def spearman_matrix(spark, sf):
    return rounded(RK.spearman(_analysis(spark, sf), FE.CORE))


@query("spearman_bootstrap")
def spearman_bootstrap(spark, sf):
    rows = materialize(_analysis(spark, sf))
    return rounded(RK.spearman(rows, FE.CORE, n_boot=50, key="article_id"))


MWU = """m as (select {by}, count(*) filter (g) n1, count(*) filter (not g) n2, sum(rk) filter (g) r1 from rk group by {by}),
ti as (select {by}, sum(c * c * c - c)::double ties from (select {by}, x, count(*)::double c from rk group by all) group by {by}),
mw as (select m.*, r1 - n1 * (n1 + 1) / 2.0 u, ties from m join ti using ({by})),
mz as (select *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2)::double * (n1 + n2 - 1)))) z from mw)"""


@query(
    "top_decile_mwu",
    ANALYSIS
    + f""", thr as (select quantile_cont(citations, 0.9::double) t from an), l as ({_long(FE.CORE)}),
    rk as (select feature, x, yy >= t g, {AVGRANK.format(c='x')} rk from l, thr), {MWU.format(by='feature')},
    md as (select feature, median(x) filter (g) median_top, median(x) filter (not g) median_rest from rk group by feature)
    select feature, n1 n_top, n2 n_rest, {r6('median_top')} median_top, {r6('median_rest')} median_rest, u::double "U", {r6('least(1, ' + normal_two_sided_sql('z') + ')')} p,
      {r6('2 * u / (n1 * n2)::double - 1')} rank_biserial from mz join md using (feature) where n1 >= 2 and n2 >= 2""",
)
def top_decile_mwu(spark, sf):
    return rounded(RK.top_decile_test(_analysis(spark, sf), FE.CORE))


EMB = "e as (select label, embedding[1]::double x from embeddings)"


@query(
    "kruskal_groups",
    f"""with {EMB}, r as (select label, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rk from e),
    s as (select label, sum(rk)::double rs, count(*) n from r group by label), tt as (select sum(c * c * c - c)::double ties from (select count(*)::double c from e group by x)),
    k as (select count(*) k, sum(n)::bigint n, sum(rs * rs / n) s from s),
    hh as (select k, n, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n::double * n * n - n)) h from k, tt)
    select k, n, {r6('h')} "H", {r6(chi2_sf_sql('h', 'k - 1'))} p from hh""",
)
def kruskal_groups(spark, sf):
    e = D.table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    return rounded(RK.kruskal_wallis(e, "label", "x"))


@query(
    "pairwise_mwu",
    f"""with {EMB}, pr as (select a.label a, b.label b from (select distinct label from e) a join (select distinct label from e) b on a.label < b.label),
    z0 as (select pr.a, pr.b, x, e.label = pr.a g from pr join e on e.label = pr.a or e.label = pr.b),
    rk as (select *, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 rk from z0), {MWU.format(by='a, b')},
    pp as (select a, b, u::double u, least(1, {normal_two_sided_sql('z')}) p from mz),
    q as (select *, p * count(*) over () / row_number() over (order by p, a || '|' || b) q from pp)
    select a, b, u "U", {r6('p')} p, {r6("least(1, min(q) over (order by p desc, a || '|' || b desc rows unbounded preceding))")} p_bh from q""",
)
def pairwise_mwu(spark, sf):
    e = D.table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    return rounded(RK.pairwise_mann_whitney(e, "label", "x"))


@query("kmeans_profiles")
def kmeans_profiles(spark, sf):
    rows = materialize(_analysis(spark, sf))
    assigned, _ = K.kmeans_assign(rows, FE.EXTENDED, k_range=range(2, 5), n_init=2)
    return K.cluster_profiles(assigned, FE.EXTENDED)


@query("elastic_net_cv")
def elastic_net_cv(spark, sf):
    return rounded(RG.penalised_regression(materialize(_analysis(spark, sf)), FE.FULL, "citations", "article_id"))


def _capped(spark, sf):
    return materialize(RK.winsorize(_analysis(spark, sf), "citations", 0.99))


@query("nb_regression")
def nb_regression(spark, sf):
    return rounded(RG.nb_regression(_capped(spark, sf), FE.CORE, "citations_w"), 4)


@query("quantile_regression")
def quantile_regression(spark, sf):
    return rounded(RG.quantile_regression(_capped(spark, sf), FE.CORE, "citations_w"), 4)
