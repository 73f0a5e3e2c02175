"""Queries on resampling, tests and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlytics.operators import agreement as G
from spanlytics.operators import contrasts as C
from spanlytics.operators import evaluate as E
from spanlytics.operators import significance as S
from spanlytics.operators.records import score_records
from spanlytics.plans import derived as D
from spanlytics.plans.derived_sql import KEYS as K, LABEL_LIST, h, scored, units_prefix
from spanlytics.plans.registry import query, r6, rounded
from spanlytics.plans.scoring import scores
from spanlytics.session import materialize

B = S.RESAMPLES
SEED = S.SEED


# ------------------------------------------------------------- SQL forms of tail probabilities


def simpson(f, a: str, b: str, n: int) -> str:
    """Simpson sum of ``f(t)`` from a to b as a SQL expression."""
    t = f"(({a}) + (({b}) - ({a})) * i / {n}.0)"
    w = f"(case when i = 0 or i = {n} then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"(list_sum(list_transform(range(0, {n} + 1), lambda i: {w} * ({f(t)}))) * (({b}) - ({a})) / {3 * n}.0)"


def normal_two_sided_sql(z: str) -> str:
    return f"(2 * {simpson(lambda t: f'exp(-{t} * {t} / 2) / sqrt(2 * pi())', f'abs({z})', f'abs({z}) + 12', 2000)})"


def chi2_sf_sql(x: str, df: str) -> str:
    f = lambda t: f"exp((({df}) / 2.0 - 1) * ln({t} + 1e-300) - {t} / 2 - ({df}) / 2.0 * ln(2) - lgamma(({df}) / 2.0))"
    return f"(case when ({x}) <= 0 then 1 else {simpson(f, x, f'({x}) + 150', 20000)} end)"


def beta_cdf_sql(x: str, a: str, b: str, n: int = 20000) -> str:
    f = lambda t: f"exp((({a}) - 1) * ln({t} + 1e-300) + (({b}) - 1) * ln(1 - {t} + 1e-300) + lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}))"
    return simpson(f, f"greatest(0.0, ({x}) - 0.5)", x, n)


def student_two_sided_sql(t: str, df: str) -> str:
    f = lambda x: f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0) - ln(({df}) * pi()) / 2 - (({df}) + 1) / 2.0 * ln(1 + {x} * {x} / ({df})))"
    return f"(1 - 2 * {simpson(f, '0.0', f'abs({t})', 4000)})"


def binom_cdf_sql(k: str, n: str) -> str:
    return (
        f"list_sum(list_transform(range(0, ({k})::bigint + 1), lambda i: exp(lgamma(({n}) + 1) - lgamma(i + 1)"
        f" - lgamma(({n}) - i + 1) - ({n}) * ln(2))))"
    )


def mcnemar_sql(source: str, family: str) -> str:
    """CTEs ``d`` (discordant counts) and ``mc`` (p-values) over columns a, b of ``source``."""
    comma = f"{family}, " if family else ""
    cdf, pmf = binom_cdf_sql("least(b, c)", "(b + c)"), "exp(lgamma(b + c + 1) - lgamma(b + 1) - lgamma(c + 1) - (b + c) * ln(2))"
    chi = "(abs(b - c) - 1)::double * (abs(b - c) - 1) / (b + c)"
    return f"""d as (select {comma}count(*) filter (a = 1 and b = 0) b, count(*) filter (a = 0 and b = 1) c from {source} group by all),
mc as (select {comma}b, c, b + c n_discordant,
  case when b + c = 0 then 1 else least(1, 2 * {cdf}) end p_exact,
  case when b + c = 0 then 1 else least(1, 2 * ({cdf} - {pmf} / 2)) end p_midp,
  case when b + c = 0 then 0 else {chi} end chi2_cc,
  case when b + c = 0 then 1 else {normal_two_sided_sql(f'sqrt({chi})')} end p_chi2_cc from d)"""


def holm_sql(p: str, family: str, tie: str) -> str:
    """Expression for a column ``s_<p>`` to be prepared by ``holm_step``."""
    return f"least(1, max(s_{p}) over (partition by {family} order by coalesce({p}, 1), {tie} rows unbounded preceding))"


def holm_step(p: str, family: str, tie: str) -> str:
    return (
        f"(count(*) over (partition by {family}) - row_number() over (partition by {family} order by coalesce({p}, 1), {tie}) + 1)"
        f" * coalesce({p}, 1) s_{p}"
    )


# ------------------------------------------------------------- tests and agreement on plain tables

MC = mcnemar_sql("(select quality a, toxic b from labels)", "")


@query("mcnemar_labels", f"with {MC} select b, c, n_discordant, {r6('p_exact')} p_exact, {r6('p_midp')} p_midp, {r6('chi2_cc')} chi2_cc, {r6('p_chi2_cc')} p_chi2_cc from mc")
def mcnemar_labels(spark, sf):
    rated = D.table(spark, sf, "labels").select(F.lit(0).alias("all"), F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return rounded(S.mcnemar(rated, ["all"]).drop("all"))


_FAM = mcnemar_sql("(select lang, source, quality a, toxic b from labels join documents using (doc_id))", "lang, source")


def _family(spark, sf):
    rated = D.table(spark, sf, "labels").join(D.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return S.mcnemar(rated.withColumnsRenamed({"quality": "a", "toxic": "b"}), ["lang", "source"])


@query(
    "holm_family",
    f"with {_FAM}, st as (select *, {holm_step('p_midp', 'lang', 'source')} from mc)"
    f" select lang, source, {r6('p_midp')} p_midp, {r6(holm_sql('p_midp', 'lang', 'source'))} p_holm from st",
)
def holm_family(spark, sf):
    out = S.holm(_family(spark, sf), ["lang"], "p_midp", "p_holm", tie="source")
    return rounded(out.select("lang", "source", "p_midp", "p_holm"))


@query(
    "bh_family",
    f"with {_FAM}, st as (select *, p_midp * count(*) over (partition by lang) / row_number() over (partition by lang order by p_midp, source) q from mc)"
    f" select lang, source, {r6('p_midp')} p_midp, {r6('least(1, min(q) over (partition by lang order by p_midp desc, source desc rows unbounded preceding))')} p_bh from st",
)
def bh_family(spark, sf):
    out = S.benjamini_hochberg(_family(spark, sf), ["lang"], "p_midp", "p_bh", tie="source")
    return rounded(out.select("lang", "source", "p_midp", "p_bh"))


@query(
    "cohen_kappa_labels",
    f"""with t as (select lang, quality x, toxic y from labels join documents using (doc_id)),
    c as (select lang, count(*) n, count(*) filter (x = y) same, count(*) filter (x = 0)::double x0, count(*) filter (x = 1)::double x1,
      count(*) filter (y = 0)::double y0, count(*) filter (y = 1)::double y1 from t group by all),
    k as (select lang, n, same::double / n po, (x0 * y0 + x1 * y1) / (n::double * n) pe from c)
    select lang, n, {r6('po')} agreement, {r6('pe')} chance, {r6('case when pe < 1 then (po - pe) / (1 - pe) else 1 end')} kappa from k""",
)
def cohen_kappa_labels(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "lang")
    return rounded(G.cohen_kappa(D.table(spark, sf, "labels").join(docs, "doc_id"), "quality", "toxic", ["lang"]))


FILLED = "filled as materialized (select dataset, backend, config_id, run, unit_id, coalesce(pred_label, 'None') lab from units)"
FLEISS = """cell as (select dataset, backend, config_id, unit_id, lab, count(*)::double n from filled group by all),
pu as (select dataset, backend, config_id, unit_id, sum(n) k, sum(n * n) sq from cell group by all),
pb as (select dataset, backend, config_id, count(*) n_units, max(k) k, avg((sq - k) / (k * (k - 1))) p_bar from pu group by all),
pj as (select dataset, backend, config_id, sum(n) n from cell group by dataset, backend, config_id, lab),
pe as (select dataset, backend, config_id, sum(n * n) / (sum(n) * sum(n)) p_e from pj group by all),
fk as (select dataset, backend, config_id, n_units, case when p_e < 1 then (p_bar - p_e) / (1 - p_e) else 1 end fleiss_kappa
  from pb join pe using (dataset, backend, config_id))"""


def _labels(s):
    """Unit labels of the runs of each system; units that all runs label alike are one row."""
    return s.alike(C.SYSTEM, ["run"], "pred_label")


@query("fleiss_kappa_runs", units_prefix((1,), FILLED, FLEISS) + f" select dataset, backend, config_id, n_units, {r6('fleiss_kappa')} fleiss_kappa from fk")
def fleiss_kappa_runs(spark, sf):
    u = _labels(scores(spark, sf)).withColumn("label", F.coalesce("pred_label", F.lit("None")))
    return rounded(G.fleiss_kappa(u, "unit_id", "label", C.SYSTEM))


@query(
    "icc_oneway",
    f"""with r as (select user_id, event_type, avg(value) v from events where event_type in ('click', 'view') group by all),
    s as (select user_id, count(*)::double k, avg(v) m, var_samp(v) va from r group by all having count(*) = 2),
    t as (select count(*) n_subjects, max(k) * var_samp(m) msb, avg(va) msw, max(k) k from s)
    select n_subjects, {r6('msb')} msb, {r6('msw')} msw, {r6('(msb - msw) / (msb + (k - 1) * msw)')} icc from t""",
)
def icc_oneway(spark, sf):
    ev = D.table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    rated = ev.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    full = rated.groupBy("user_id").count().filter(F.col("count") == 2)
    return rounded(G.icc_oneway(rated.join(full, "user_id"), "user_id", "v"))


AGREE = """pr as (select a.dataset, a.backend, a.config_id, a.run ra, b.run rb, a.lab la, b.lab lb
  from filled a join filled b on a.dataset = b.dataset and a.backend = b.backend and a.config_id = b.config_id and a.unit_id = b.unit_id and a.run < b.run),
pn as (select dataset, backend, config_id, ra, rb, count(*) n, count(*) filter (la = lb) same from pr group by all),
ma as (select dataset, backend, config_id, ra, rb, la lab, count(*)::double na from pr group by all),
mb as (select dataset, backend, config_id, ra, rb, lb lab, count(*)::double nb from pr group by all),
cr as (select dataset, backend, config_id, ra, rb, sum(na * nb) x from ma join mb using (dataset, backend, config_id, ra, rb, lab) group by all),
kp as (select pn.*, same::double / n po, x / (n::double * n) pe from pn join cr using (dataset, backend, config_id, ra, rb)),
ag as (select dataset, backend, config_id, avg(po) pairwise_agreement, coalesce(stddev_samp(po), 0) pairwise_agreement_sd,
  avg(case when pe < 1 then (po - pe) / (1 - pe) else 1 end) pairwise_cohen_kappa, max(n) n_units from kp group by all)"""


@query(
    "inter_run_agreement",
    units_prefix((1,), FILLED, FLEISS, AGREE)
    + f""" select dataset, backend, config_id, {r6('pairwise_agreement')} pairwise_agreement, {r6('pairwise_agreement_sd')} pairwise_agreement_sd,
      {r6('pairwise_cohen_kappa')} pairwise_cohen_kappa, ag.n_units, {r6('fleiss_kappa')} fleiss_kappa, 2::bigint n_runs
      from ag join fk using (dataset, backend, config_id)""",
)
def inter_run_agreement(spark, sf):
    return rounded(G.inter_run_agreement(materialize(_labels(scores(spark, sf))), C.SYSTEM))


@query(
    "anova_embeddings",
    f"""with t as (select label g, embedding[1]::double v from embeddings),
    s as (select g, count(*) n, avg(v) m, coalesce(var_pop(v), 0) va from t group by all),
    u as (select count(*) k, sum(n) nn, sum(n * va) ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) ssb from s),
    f as (select (ssb / (k - 1)) / (ssw / (nn - k)) f, (k - 1)::double d1, (nn - k)::double d2 from u)
    select {r6('f')} "F", d1 df1, d2 df2, {r6(beta_cdf_sql('d2 / (d2 + d1 * f)', 'd2 / 2', 'd1 / 2'))} p from f""",
)
def anova_embeddings(spark, sf):
    e = D.table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v"))
    return rounded(S.anova_oneway(e, "label", "v"))


@query(
    "mean_sd",
    f"select event_type, {r6('avg(value)')} mean, {r6('coalesce(stddev_samp(value), 0)')} sd, count(value) n from events group by all",
)
def mean_sd(spark, sf):
    return rounded(S.mean_sd(D.table(spark, sf, "events"), ["event_type"], "value"))


# ------------------------------------------------------------- resampling and comparison tables

_C = ["n_units", "n_correct", "tp", "fp", "fn"]


def _pool(where: str, name: str = "pooled") -> str:
    sums = ", ".join(f"sum({c}) {c}" for c in _C)
    return f"{name} as (select dataset, backend, config_id, review_id, {sums} from review_counts where {where} group by all)"


def _f1(s: str) -> str:
    p, r = f"coalesce({s}_tp::double / nullif({s}_tp + {s}_fp, 0), 0)", f"coalesce({s}_tp::double / nullif({s}_tp + {s}_fn, 0), 0)"
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


def _acc(s: str) -> str:
    return f"({s}_n_correct::double / nullif({s}_n_units, 0))"


_AB = ", ".join(f"{s}.{c} {s}_{c}" for s in "ab" for c in _C)
_SUMAB = ", ".join(f"sum({s}_{c}) {s}_{c}" for s in "ab" for c in _C)


_W = " + ".join(f"(x >= {t})::int" for t in S.THRESHOLDS)


def boot_sql(name: str, fam: str, seed: int, metric: str) -> str:
    """CTE ``name`` with point values, interval and p per family, from a CTE ``paired``."""
    m = _f1 if metric == "f1" else _acc
    step = lambda k, c: f"(x{k} * x{k} + {c}) % {S.PRIME}"
    return f"""{name}_x0 as (select dataset, review_id, b::int b, ({h(str(seed), 'dataset', 'review_id')} % {S.PRIME} + b * {S.STRIDE}) % {S.PRIME} x0
  from (select distinct dataset, review_id from paired), range(0, {B}) t(b)),
{name}_x1 as (select dataset, review_id, b, {step(0, S.SUMMANDS[0])} x1 from {name}_x0),
{name}_x2 as (select dataset, review_id, b, {step(1, S.SUMMANDS[1])} x2 from {name}_x1),
{name}_x3 as (select dataset, review_id, b, {step(2, S.SUMMANDS[2])} x from {name}_x2),
{name}_w as materialized (select * from (select dataset, review_id, b, {_W} w from {name}_x3) where w > 0),
{name}_sum as (select {', '.join('p.' + c.strip() for c in fam.split(','))}, w.b, {', '.join(f'sum({s}_{c} * w) {s}_{c}' for s in 'ab' for c in _C)}
  from {name}_w w join paired p on p.dataset = w.dataset and p.review_id = w.review_id group by all),
{name}_d as materialized (select {fam}, b, {m('a')} - {m('b')} delta from {name}_sum),
{name}_ci as (select {fam}, count(delta) n_resamples, quantile_cont(delta, 0.025::double) ci_low, quantile_cont(delta, (1 - 0.025)::double) ci_high,
  least(1, 2 * least((count(*) filter (delta <= 0) + 1)::double / (count(delta) + 1), (count(*) filter (delta >= 0) + 1)::double / (count(delta) + 1))) p_value,
  avg(delta) boot_mean, stddev_samp(delta) boot_sd from {name}_d where delta is not null group by all),
{name}_pt as (select {fam}, count(*) n_reviews, {_SUMAB} from paired group by all),
{name} as materialized (select p.*, {m('a')} value_a, {m('b')} value_b, {m('a')} - {m('b')} delta, c.n_resamples, c.ci_low, c.ci_high, c.p_value, c.boot_mean, c.boot_sd
  from {name}_pt p join {name}_ci c using ({fam}))"""


ABLATION = f"""{_pool('round = 1')},
paired as materialized (select a.dataset, a.backend, b.config_id ablation, a.review_id, {_AB}
  from pooled a join pooled b using (dataset, backend, review_id) where a.config_id = 'F' and b.config_id <> 'F')"""
MAJORITY = "maj as (select dataset, backend, config_id, unit_id, (avg(correct) >= 0.5)::int ok from units where round = 1 group by all)"
FAM = "dataset, backend, ablation"


def _counts(spark, sf, rounds=(1,), only=None):
    """Counters by review and run, and the scores they are from; ``only`` keeps the runs of one configuration."""
    s = scores(spark, sf, rounds) if only is None else score_records(D.records(spark, sf, rounds).filter(F.col("config_id") == only))
    return materialize(E.review_counts(s)), s


@query(
    "paired_bootstrap_f1",
    scored() + f", {ABLATION}, {boot_sql('f1', FAM, SEED, 'f1')} select {FAM}, n_reviews, {r6('value_a')} value_a, {r6('value_b')} value_b, {r6('delta')} delta,"
    f" n_resamples, {r6('ci_low')} ci_low, {r6('ci_high')} ci_high, {r6('p_value')} p_value, {r6('boot_mean')} boot_mean, {r6('boot_sd')} boot_sd from f1",
)
def paired_bootstrap_f1(spark, sf):
    counts, _ = _counts(spark, sf)
    paired = C._full_against(counts, "pooled")
    out = S.paired_bootstrap(paired, FAM.split(", "), "f1", B, SEED, ["dataset"])
    return rounded(out)


@query(
    "poisson_bootstrap_f1",
    scored()
    + f""", {ABLATION}, {boot_sql('f1', FAM, SEED + 21, 'f1')}
    select {FAM}, n_resamples, {r6('ci_low')} ci_low, {r6('ci_high')} ci_high, {r6('boot_mean')} boot_mean from f1""",
)
def poisson_bootstrap_f1(spark, sf):
    counts, _ = _counts(spark, sf)
    fam = FAM.split(", ")
    sums = S.resampled_sums(C._full_against(counts, "pooled"), fam, B, SEED + 21, ["dataset"], "poisson")
    out = S.summarise(S.deltas(sums, fam), fam)
    return rounded(out.select(*fam, "n_resamples", "ci_low", "ci_high", "boot_mean"))


@query(
    "bootstrap_contrast",
    scored()
    + f""", {ABLATION}, {boot_sql('f1', FAM, SEED + 7, 'f1')},
    x as (select d1.backend, d1.ablation, d1.b, d1.delta - d2.delta c from f1_d d1 join f1_d d2 using (backend, ablation, b) where d1.dataset = 'en' and d2.dataset = 'fr'),
    y as (select backend, ablation, quantile_cont(c, 0.025::double) ci_low, quantile_cont(c, (1 - 0.025)::double) ci_high,
      least(1, 2 * least((count(*) filter (c <= 0) + 1)::double / (count(c) + 1), (count(*) filter (c >= 0) + 1)::double / (count(c) + 1))) p_value from x group by all)
    select backend, ablation, {r6('p1.delta')} delta_1, {r6('p2.delta')} delta_2, {r6('p1.delta - p2.delta')} contrast, {r6('y.ci_low')} ci_low, {r6('y.ci_high')} ci_high,
      {r6('y.p_value')} p_value, 'en' dataset_1, 'fr' dataset_2
    from y join f1 p1 using (backend, ablation) join f1 p2 using (backend, ablation) where p1.dataset = 'en' and p2.dataset = 'fr'""",
)
def bootstrap_contrast(spark, sf):
    counts, _ = _counts(spark, sf)
    return rounded(C.dataset_contrast(counts, "en", "fr", B, SEED))


_PR = ", ".join(
    r6(f"coalesce(t.{s}_tp::double / nullif(t.{s}_tp + t.{s}_{o}, 0), 0)") + f" {m}_{w}"
    for s, w in (("a", "full"), ("b", "ablated"))
    for m, o in (("precision", "fp"), ("recall", "fn"))
)


@query(
    "ablation_main",
    scored()
    + f""", {ABLATION}, {boot_sql('f1', FAM, SEED, 'f1')}, {boot_sql('acc', FAM, SEED + 1, 'acc')}, {MAJORITY},
    duo as (select a.dataset, a.backend, b.config_id ablation, a.ok a, b.ok b from maj a join maj b using (dataset, backend, unit_id) where a.config_id = 'F' and b.config_id <> 'F'),
    sz as (select {FAM}, count(*) n_units from duo group by all), {mcnemar_sql('duo', FAM)},
    t as (select f1.*, f1.p_value p_f1, acc.p_value p_acc, mc.p_exact p_mcnemar, acc.value_a acc_a, acc.value_b acc_b, acc.delta delta_acc,
      acc.ci_low acc_ci_low, acc.ci_high acc_ci_high, mc.b mcnemar_b, mc.c mcnemar_c, sz.n_units n_units
      from f1 join acc using ({FAM}) join mc using ({FAM}) join sz using ({FAM})),
    st as (select *, {', '.join(holm_step(p, 'dataset, backend', 'ablation') for p in ('p_f1', 'p_acc', 'p_mcnemar'))} from t)
    select {FAM}, n_reviews, {r6('value_a')} f1_a, {r6('value_b')} f1_b, {r6('delta')} delta_f1, {r6('ci_low')} f1_ci_low, {r6('ci_high')} f1_ci_high, {r6('p_f1')} p_f1,
      {r6('acc_a')} acc_a, {r6('acc_b')} acc_b, {r6('delta_acc')} delta_acc, {r6('acc_ci_low')} acc_ci_low, {r6('acc_ci_high')} acc_ci_high, {r6('p_acc')} p_acc,
      a_n_units::bigint n_unit_run_pairs, {_PR}, mcnemar_b, mcnemar_c, {r6('p_mcnemar')} p_mcnemar, n_units,
      {', '.join(r6(holm_sql(p, 'dataset, backend', 'ablation')) + ' ' + p.replace('p_', 'p_adj_') for p in ('p_f1', 'p_acc', 'p_mcnemar'))}
    from st t""",
)
def ablation_main(spark, sf):
    counts, s = _counts(spark, sf)
    units = materialize(s.alike(["dataset", "backend"], ["config_id", "run"], "correct"))
    return rounded(C.ablation_main(counts, units, B, SEED))


@query(
    "backend_pairwise",
    scored()
    + f""", {_pool("round = 1 and config_id = 'F'")},
    paired as materialized (select a.dataset, a.backend backend_a, b.backend backend_b, a.review_id, {_AB} from pooled a join pooled b using (dataset, review_id) where a.backend < b.backend),
    {boot_sql('f1', 'dataset, backend_a, backend_b', SEED + 3, 'f1')}, {MAJORITY},
    duo as (select a.dataset, a.backend backend_a, b.backend backend_b, a.ok a, b.ok b from maj a join maj b using (dataset, unit_id)
      where a.config_id = 'F' and b.config_id = 'F' and a.backend < b.backend),
    {mcnemar_sql('duo', 'dataset, backend_a, backend_b')},
    t as (select f1.*, p_value p_bootstrap, mc.p_exact p_mcnemar, mc.b mcnemar_b, mc.c mcnemar_c from f1 join mc using (dataset, backend_a, backend_b)),
    st as (select *, {holm_step('p_bootstrap', 'dataset', 'backend_b')}, {holm_step('p_mcnemar', 'dataset', 'backend_b')} from t)
    select dataset, backend_a, backend_b, {r6('value_a')} f1_a, {r6('value_b')} f1_b, {r6('delta')} delta_f1, {r6('ci_low')} ci_low, {r6('ci_high')} ci_high,
      {r6('p_bootstrap')} p_bootstrap, mcnemar_b, mcnemar_c, {r6('p_mcnemar')} p_mcnemar,
      {r6(holm_sql('p_bootstrap', 'dataset', 'backend_b'))} p_adj_bootstrap, {r6(holm_sql('p_mcnemar', 'dataset', 'backend_b'))} p_adj_mcnemar from st""",
)
def backend_pairwise(spark, sf):
    counts, s = _counts(spark, sf, only="F")
    units = materialize(s.alike(["dataset"], ["backend", "config_id", "run"], "correct"))
    return rounded(C.backend_pairwise(counts, units, B, SEED))


_RUNS = ", ".join(f"sum({c}) a_{c}" for c in _C)


@query(
    "multirun_stability",
    scored()
    + f""", {FILLED}, {FLEISS}, {AGREE},
    pr0 as (select dataset, backend, config_id, run, {_RUNS} from review_counts group by all),
    pm as (select dataset, backend, config_id, run, {_acc('a')} accuracy, {_f1('a')} f1 from pr0),
    st as (select dataset, backend, config_id, count(distinct run) n_runs, avg(accuracy) accuracy_mean, coalesce(stddev_samp(accuracy), 0) accuracy_sd,
      avg(f1) f1_mean, coalesce(stddev_samp(f1), 0) f1_sd from pm group by all)
    select dataset, backend, config_id, n_runs, {r6('accuracy_mean')} accuracy_mean, {r6('accuracy_sd')} accuracy_sd, {r6('f1_mean')} f1_mean, {r6('f1_sd')} f1_sd,
      {r6('pairwise_agreement')} inter_run_agreement, {r6('pairwise_agreement_sd')} inter_run_agreement_sd, {r6('fleiss_kappa')} inter_run_fleiss_kappa
    from st join ag using (dataset, backend, config_id) join fk using (dataset, backend, config_id)""",
)
def multirun_stability(spark, sf):
    counts, s = _counts(spark, sf)
    return rounded(C.multirun_stability(counts, materialize(_labels(s))))


_LABROUND = ", ".join(
    f"avg(correct) filter (round = {r} and gold_label = '{lab}') \"{lab}_acc_r{r}\""
    for lab in ("Eval_pos", "Eval_neg", "Jus_pos", "Jus_neg", "Major_Claim")
    for r in (1, 2)
)
_LABOUT = ", ".join(
    f"{r6(f'{lab}_acc_r1')} {lab}_acc_r1, {r6(f'{lab}_acc_r2')} {lab}_acc_r2, {r6(f'{lab}_acc_r2 - {lab}_acc_r1')} {lab}_delta"
    for lab in ("Eval_pos", "Eval_neg", "Jus_pos", "Jus_neg", "Major_Claim")
)


@query(
    "round_comparison",
    scored((1, 2))
    + f""", {_pool('round = 2', 'p2')}, {_pool('round = 1', 'p1')},
    paired as materialized (select a.dataset, a.backend, a.config_id, a.review_id, {_AB} from p2 a join p1 b using (dataset, backend, config_id, review_id)),
    {boot_sql('f1', 'dataset, backend, config_id', SEED + 11, 'f1')}, {boot_sql('acc', 'dataset, backend, config_id', SEED + 12, 'acc')},
    lr as (select dataset, backend, config_id, {_LABROUND} from units group by all)
    select dataset, backend, config_id, f1.n_reviews, {r6('f1.value_a')} f1_a, {r6('f1.value_b')} f1_b, {r6('f1.delta')} delta_f1, {r6('f1.ci_low')} f1_ci_low,
      {r6('f1.ci_high')} f1_ci_high, {r6('f1.p_value')} p_f1, {r6('acc.value_a')} acc_a, {r6('acc.value_b')} acc_b, {r6('acc.delta')} delta_acc,
      {r6('acc.ci_low')} acc_ci_low, {r6('acc.ci_high')} acc_ci_high, {r6('acc.p_value')} p_acc, {_LABOUT}
    from f1 join acc using (dataset, backend, config_id) join lr using (dataset, backend, config_id)""",
)
def round_comparison(spark, sf):
    counts, s = _counts(spark, sf, (1, 2))
    made = s.counts([*C.SYSTEM, "round"])
    answers = [F.struct(F.lit(v).alias("correct"), n.alias(G.ALIKE)) for v, n in ((1, F.col("n_correct")), (0, F.col("n_units") - F.col("n_correct")))]
    units = made.select(*C.SYSTEM, "round", F.col("label").alias("gold_label"), F.inline(F.array(*answers)))
    return rounded(C.round_comparison(counts, units, B, SEED))
