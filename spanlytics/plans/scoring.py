"""Queries on span scoring, audit and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanlytics.operators import audit as A
from spanlytics.operators import evaluate as E
from spanlytics.operators import report as R
from spanlytics.operators.align import with_token_ranges
from spanlytics.operators.matching import KEYS, overlap_pairs, same_label
from spanlytics.operators.records import RecordScores, score_records
from spanlytics.plans import derived as D
from spanlytics.plans.derived_sql import (
    KEYS as K,
    LABEL_IN,
    LABEL_LIST,
    METRICS,
    SUM_COLUMNS,
    gold_prefix,
    pairs_prefix,
    pred_prefix,
    scored,
    units_prefix,
)
from spanlytics.plans.registry import query, r6, rounded
from spanlytics.session import materialize, shared_folder
from spanlytics.sources import runs as RUN

GRID = E.TAUS


def inputs(spark, sf, rounds=(1,)):
    """Results, predictions and gold; the predictions are written once as a run would do."""
    return D.results(spark, sf, rounds), materialize(D.pred(spark, sf, rounds)), D.gold(spark, sf)


def scores(spark, sf, rounds=(1,)) -> RecordScores:
    return score_records(D.records(spark, sf, rounds))


def master(spark, sf, rounds=(1,), taus=None):
    return materialize(E.master_results(scores(spark, sf, rounds), taus))


MASTER = f"""master as materialized (
  select {K}, tau, {SUM_COLUMNS} from review_counts group by all
  union all by name
  select 'pooled' dataset, backend, config_id, run, round, tau, {SUM_COLUMNS} from review_counts
  group by backend, config_id, run, round, tau having count(distinct dataset) >= 2),
metrics as materialized (select *, {METRICS} from master)"""
RATES = f"""{r6("(n_exact + n_normalized + n_fuzzy)::double / nullif(n_pred, 0)")} recoverable_span_rate,
  {r6("n_rejected::double / nullif(n_pred, 0)")} rejected_span_rate,
  {r6("n_fuzzy::double / nullif(n_pred, 0)")} fuzzy_span_rate,
  {r6("exact_span_matches::double / nullif(n_units, 0)")} exact_span_match_rate,
  {r6("sum_best_iou / nullif(n_units, 0)")} mean_token_iou"""


@query("gold_spans", gold_prefix() + " select review_id, dataset, g_idx, ts, tj, label from gold")
def gold_spans(spark, sf):
    return D.gold(spark, sf).select("review_id", "dataset", "g_idx", "ts", "tj", "label")


@query(
    "prediction_view",
    pred_prefix()
    + f""" select {K}, case when status in ('exact','normalized','fuzzy') and label not in {LABEL_IN}
        then 'illegal_label' else status end status, count(*) n,
        count(*) filter (status in ('exact','normalized','fuzzy') and tj > ts) n_recovered
      from pred group by all""",
)
def prediction_view(spark, sf):
    view = E.prediction_view(D.pred(spark, sf))
    good = F.coalesce(F.col("status").isin("exact", "normalized", "fuzzy") & (F.col("end") > F.col("start")), F.lit(False))
    return view.groupBy(*KEYS, "status").agg(F.count("*").alias("n"), F.count_if(good).alias("n_recovered"))


@query(
    "span_pairs_iou",
    pairs_prefix()
    + f""" select {K}, g_label, count(*) n_pairs, sum(ov)::bigint shared_tokens, {r6("avg(iou)")} mean_iou,
        {r6("max(iou)")} max_iou from pairs where p_label = g_label group by all""",
)
def span_pairs_iou(spark, sf):
    _, pred, gold = inputs(spark, sf)
    pairs = same_label(overlap_pairs(pred, gold))
    return rounded(
        pairs.groupBy(*KEYS, "g_label").agg(
            F.count("*").alias("n_pairs"),
            F.sum("overlap").alias("shared_tokens"),
            F.avg("iou").alias("mean_iou"),
            F.max("iou").alias("max_iou"),
        )
    )


@query(
    "greedy_matches",
    scored() + f" select {K}, review_id, g_label, p_idx, g_idx, {r6('iou')} iou from matches",
)
def greedy_matches(spark, sf):
    found = scores(spark, sf).matches
    return rounded(found.select(*KEYS, "review_id", "g_label", "p_idx", "g_idx", "iou"))


PRF = f"""select {K}, {SUM_COLUMNS.split(', sum(n_pred)')[0]} from review_counts group by all"""


@query(
    "span_prf_by_run",
    scored()
    + f", t as (select {K}, count(*) n_reviews, sum(n_units)::bigint n_units, sum(n_correct)::bigint n_correct,"
    " sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from review_counts group by all)"
    f" select *, {METRICS} from t",
)
def span_prf_by_run(spark, sf):
    s = scores(spark, sf)
    counts = s.counts(KEYS, [0.5], label=False)
    keep = [*KEYS, "n_reviews", "n_units", "n_correct", "tp", "fp", "fn", "accuracy", "precision", "recall", "f1"]
    return rounded(E.with_prf(E.at_taus(counts, KEYS, [0.5])).select(*keep))


@query(
    "runs_to_scores",
    scored()
    + f""", {MASTER} select dataset, backend, config_id, run, round, n_units, n_correct, tp, fp, fn, accuracy, "precision", recall, f1
      from (select *, {METRICS} from (select dataset, backend, config_id, run, round, sum(n_units)::bigint n_units, sum(n_correct)::bigint n_correct,
        sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from review_counts where dataset in ('en', 'fr') group by all))""",
)
def runs_to_scores(spark, sf):
    """Runs written in folders by run key, read back for two datasets (other folders are not opened), scored, and the table written and read."""
    path = f"{shared_folder(spark)}/scored-{uuid.uuid4().hex}"
    results, pred, gold = D.results(spark, sf), D.pred(spark, sf), D.gold(spark, sf)
    RUN.write_run(results, f"{path}/results")
    RUN.write_run(pred, f"{path}/predictions")
    wanted = ["en", "fr"]
    done, spans = (RUN.read_runs(spark, f"{path}/{name}", wanted) for name in ("results", "predictions"))
    s = E.score(done.select(*results.columns), spans.select(*pred.columns), gold)
    table = E.with_prf(E.at_taus(s.counts(KEYS, [0.5], label=False), KEYS, [0.5]))
    RUN.write_master({"master": table.select(*KEYS, "n_units", "n_correct", "tp", "fp", "fn", "accuracy", "precision", "recall", "f1")}, path)
    return rounded(spark.read.parquet(f"{path}/master"))


@query(
    "rejected_spans_excluded",
    scored()
    + f""", t as (select {K}, sum(n_units)::bigint n_units, sum(n_correct)::bigint n_correct, sum(tp)::bigint tp,
        sum(fp - n_rejected)::bigint fp, sum(fn)::bigint fn from review_counts group by all)
      select *, {METRICS} from t""",
)
def rejected_spans_excluded(spark, sf):
    counts = scores(spark, sf).counts(KEYS, [0.5], label=False)
    table = E.with_prf(E.at_taus(counts, KEYS, [0.5], policy="exclude"))
    return rounded(table.select(*KEYS, "n_units", "n_correct", "tp", "fp", "fn", *A.METRICS))


@query(
    "unit_predictions",
    units_prefix()
    + f" select {K}, unit_id, gold_label, coalesce(pred_label, 'None') pred_label, correct, {r6('best_iou')} best_iou, exact"
    " from units where config_id = 'F'",
)
def unit_predictions(spark, sf):
    units = score_records(D.records(spark, sf).filter("config_id = 'F'")).units
    return rounded(
        units.select(*KEYS, "unit_id", "gold_label", F.coalesce("pred_label", F.lit("None")).alias("pred_label"), "correct", "best_iou", "exact")
    )


@query(
    "confusion",
    units_prefix()
    + f" select {K}, gold_label gold, coalesce(pred_label, 'None') pred, count(*) \"count\" from units group by all",
)
def confusion(spark, sf):
    return E.confusion(scores(spark, sf).units)


@query(
    "review_counts",
    scored() + f" select {K}, review_id, n_units, n_correct, tp, fp, fn, n_pred, n_exact, n_normalized, n_fuzzy, n_rejected, n_illegal, exact_span_matches, {r6('sum_best_iou')} sum_best_iou from review_counts",
)
def review_counts(spark, sf):
    rc = E.review_counts(scores(spark, sf))
    return rounded(rc.drop("tau", "n_reviews"))


_CELLS = ",\n".join(
    f"coalesce(sum(case when label = '{lab}' then {expr} end), 0)::bigint \"{lab}__{name}\""
    for lab in ["Eval_pos", "Eval_neg", "Jus_pos", "Jus_neg", "Major_Claim"]
    for name, expr in (("units", "u"), ("correct", "c"), ("tp", "t"), ("fp", "p - t"), ("fn", "u - t"), ("n_pred", "p"))
)
LABEL_COUNTS = f"""lab as (
  select {K}, review_id, gold_label label, count(*) u, sum(correct) c, 0 t, 0 p from units group by all
  union all select {K}, review_id, g_label, 0, 0, count(*), 0 from matches where iou >= 0.5 group by all
  union all select {K}, review_id, label, 0, 0, 0, count(*) from pred
    where status in ('exact','normalized','fuzzy') and tj > ts and label in {LABEL_IN} group by all
  union all select {K}, review_id, null, 0, 0, 0, 0 from results)"""


@query("review_counts_wide", scored() + f", {LABEL_COUNTS} select {K}, review_id, {_CELLS} from lab group by all")
def review_counts_wide(spark, sf):
    return E.review_counts_wide(scores(spark, sf))


PER_LABEL = f"""labtau as (
  select {K}, tau, gold_label label, count(*) u, sum(correct) c, 0 t, 0 p from units, taus group by all
  union all select {K}, tau, g_label, 0, 0, count(*), 0 from matches, taus where iou >= tau group by all
  union all select {K}, tau, label, 0, 0, 0, count(*) from pred, taus
    where status in ('exact','normalized','fuzzy') and tj > ts and label in {LABEL_IN} group by all
  union all select distinct {K}, tau, l.label, 0, 0, 0, 0 from results, taus, (select unnest({LABEL_LIST}) label) l),
labsum as (select {K}, tau, label, sum(u)::bigint n_units, sum(c)::bigint n_correct, sum(t)::bigint tp,
  sum(p - t)::bigint fp, sum(u - t)::bigint fn, sum(p)::bigint n_pred from labtau group by all)"""


@query(
    "per_label_metrics",
    scored(taus=GRID)
    + f", {PER_LABEL} select {K}, tau, label, n_units units, n_correct correct, tp, fp, fn, n_pred, {METRICS} from labsum",
)
def per_label_metrics(spark, sf):
    counts = scores(spark, sf).counts(KEYS, GRID)
    return rounded(E.label_metrics(counts, KEYS, GRID))


@query("tau_sensitivity", scored(taus=GRID) + f", {MASTER}, s as (select dataset, backend, tau, sum(n_units) n_units, sum(n_correct) n_correct, sum(tp) tp, sum(fp) fp, sum(fn) fn from master where config_id = 'F' group by all), m as (select *, {METRICS} from s) select dataset, backend, tau, \"precision\", recall, f1 from m")
def tau_sensitivity(spark, sf):
    return rounded(R.tau_sensitivity(E.master_results(scores(spark, sf))))


@query(
    "status_rates",
    pred_prefix()
    + """ select backend, config_id, count(*) n_pred, count(*) filter (status='exact') n_exact,
      count(*) filter (status='normalized') n_normalized, count(*) filter (status='fuzzy') n_fuzzy,
      count(*) filter (status='rejected') n_rejected, count(*) filter (status='illegal_label') n_illegal_label
      from pred group by all""",
)
def status_rates(spark, sf):
    return E.status_rates(D.pred(spark, sf), ["backend", "config_id"])


@query(
    "master_results",
    scored(taus=GRID)
    + f", {MASTER} select {K}, tau, n_reviews, n_units, n_correct, tp, fp, fn, n_pred, n_exact, n_normalized, n_fuzzy,"
    f" n_rejected, n_illegal, exact_span_matches, {r6('sum_best_iou')} sum_best_iou, accuracy, \"precision\", recall, f1, {RATES} from metrics",
)
def master_results(spark, sf):
    return rounded(R.sort_master(E.master_results(scores(spark, sf))))


@query(
    "pooled_rows",
    scored() + f", {MASTER} select {K}, tau, n_reviews, n_units, tp, fp, fn, \"precision\", recall, f1 from metrics where dataset = 'pooled'",
)
def pooled_rows(spark, sf):
    s = scores(spark, sf)
    pooled = E.pool_datasets(s.counts(KEYS, [0.5], label=False))
    rows = E.with_rates(E.at_taus(pooled, KEYS, [0.5]))
    return rounded(rows.select(*KEYS, "tau", "n_reviews", "n_units", "tp", "fp", "fn", "precision", "recall", "f1"))


@query(
    "dataset_filter",
    scored() + f", {MASTER} select {K}, n_reviews, tp, fp, fn, f1 from metrics where dataset in ('en', 'fr')",
)
def dataset_filter(spark, sf):
    some = F.col("dataset").isin("en", "fr")
    s = score_records(D.records(spark, sf).filter(some))
    rows = E.with_prf(E.at_taus(s.counts(KEYS, [0.5], label=False), KEYS, [0.5]))
    return rounded(rows.select(*KEYS, "n_reviews", "tp", "fp", "fn", "f1"))


@query(
    "skipped_predictions",
    pred_prefix()
    + """ select p.backend, p.config_id, p.run, count(*) n_skipped from pred p
      where not exists (select 1 from labels l where l.doc_id = p.review_id) group by all""",
)
def skipped_predictions(spark, sf):
    rated = D.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    gone = E.skipped_predictions(D.pred(spark, sf), rated)
    return gone.groupBy("backend", "config_id", "run").agg(F.count("*").alias("n_skipped"))


# --------------------------------------------------------------------------- audit and reports


def tampered(spark, sf):
    """The master table with some reported numbers changed, so the audit has something to find."""
    m = master(spark, sf, taus=GRID)
    wrong = (F.col("dataset") == "fr") & (F.col("config_id") == "B0")
    return m.withColumns(
        {
            "precision": F.when(wrong, F.col("precision") + 0.01).otherwise(F.col("precision")),
            "recall": F.when(F.col("config_id") == "A5", F.col("accuracy")).otherwise(F.col("recall")),
        }
    )


_FRESH = """case when n_units > 0 then n_correct::double / n_units end acc0,
  coalesce(tp::double / nullif(tp + fp, 0), 0) p0, coalesce(tp::double / nullif(tp + fn, 0), 0) r0"""
_TAMPER = f"""fresh as (select *, {_FRESH} from master),
shown as (select *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) f0, acc0 accuracy,
  case when dataset = 'fr' and config_id = 'B0' then p0 + 0.01::double else p0 end pp,
  case when config_id = 'A5' then acc0 else r0 end rr from fresh),
shown2 as (select *, coalesce(2 * pp * rr / nullif(pp + rr, 0), 0) fh, concat_ws(' / ', dataset, backend, config_id, run) location from shown)"""


@query(
    "audit_findings",
    scored(taus=GRID)
    + f""", {MASTER}, {_TAMPER},
    found as (
      select 'ERROR' level, location, printf('precision reported %.6f but counts give %.6f', pp, p0) message from shown2 where abs(p0 - pp) > 1e-6
      union select 'ERROR', location, printf('recall reported %.6f but counts give %.6f', rr, r0) from shown2 where abs(r0 - rr) > 1e-6
      union select 'ERROR', location, printf('F1 %.6f != 2PR/(P+R) %.6f', f0, fh) from shown2 where abs(fh - f0) > 1e-6
      union select 'INFO', location, 'Accuracy equals Recall by construction: TP = N_correct and TP + FN = N' from shown2
        where abs(accuracy - rr) < 1e-9 and n_units > 0 and tp = n_correct and tp + fn = n_units
      union select 'WARN', location, 'Accuracy equals Recall numerically but not structurally; verify the counts.' from shown2
        where abs(accuracy - rr) < 1e-9 and n_units > 0 and not (tp = n_correct and tp + fn = n_units))
    select level, location, message from found""",
)
def audit_findings(spark, sf):
    return A.audit_findings(tampered(spark, sf))


@query(
    "audit_clean",
    scored(taus=GRID)
    + f""", {MASTER}, t as (select *, {_FRESH} from master)
    select 'OK' level, 'master' "location", printf('%d rows: all P/R/F1/Accuracy values are consistent with their counts', count(*)) message from t
    union all select distinct 'INFO', concat_ws(' / ', dataset, backend, config_id, run), 'Accuracy equals Recall by construction: TP = N_correct and TP + FN = N'
      from t where abs(acc0 - r0) < 1e-9 and n_units > 0 and tp = n_correct and tp + fn = n_units
    union all select distinct 'WARN', concat_ws(' / ', dataset, backend, config_id, run), 'Accuracy equals Recall numerically but not structurally; verify the counts.'
      from t where abs(acc0 - r0) < 1e-9 and n_units > 0 and not (tp = n_correct and tp + fn = n_units)""",
)
def audit_clean(spark, sf):
    return A.audit_findings(master(spark, sf, taus=GRID))


_PV = ",\n".join(
    f"{r6(f'{m}_p')} {m}_pooled, {r6(f'{m}_m')} {m}_mean_of_datasets, {r6(f'{m}_p - {m}_m')} {m}_diff"
    for m in ("accuracy", "precision", "recall", "f1")
)


@query(
    "pooled_vs_mean",
    scored(taus=GRID)
    + f""", {MASTER}, t as (select *, {_FRESH}, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::double f0 from master where dataset <> 'pooled'),
    s as (select backend, config_id, run, round, tau, count(distinct dataset) d, sum(n_units) nu, sum(n_correct) nc, sum(tp) tp, sum(fp) fp, sum(fn) fn,
      avg(acc0) accuracy_m, avg(p0) precision_m, avg(r0) recall_m, avg(f0) f1_m from t group by all having count(distinct dataset) >= 2),
    u as (select *, nc::double / nullif(nu, 0) accuracy_p, coalesce(tp::double / nullif(tp + fp, 0), 0) precision_p,
      coalesce(tp::double / nullif(tp + fn, 0), 0) recall_p, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::double f1_p from s)
    select backend, config_id, run, round, tau, {_PV} from u""",
)
def pooled_vs_mean(spark, sf):
    return rounded(A.pooled_vs_mean(E.master_results(scores(spark, sf))))


_VIEW = """view as (select dataset, backend, config_id, count(distinct run) n_runs, sum(n_units)::bigint n_units,
  sum(n_correct)::bigint n_correct, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn
  from master where tau = 0.5 and round = 1 group by all)"""


@query("reported_view", scored() + f", {MASTER}, {_VIEW} select *, {METRICS} from view")
def reported_view(spark, sf):
    return rounded(A.reported_view(E.master_results(scores(spark, sf), [0.5]), 0.5))


@query(
    "table_crosscheck",
    scored()
    + f""", {MASTER}, {_VIEW}, m as (select *, {_FRESH} from view),
    pub as (select dataset, backend, config_id, p0 a, r0 b, round(p0, 4) pa,
      case when config_id = 'B0' then round(r0, 4) + 0.001::double else round(r0, 4) end pb from m),
    long as (select dataset, backend, config_id, 'precision' metric, a master, pa published from pub
      union all select dataset, backend, config_id, 'recall', b, pb from pub)
    select dataset, backend, config_id, metric, {r6('master')} master, {r6('published')} published,
      {r6('abs(master - published)')} abs_diff, abs(master - published) <= 5e-5 ok from long""",
)
def table_crosscheck(spark, sf):
    m = materialize(E.master_results(scores(spark, sf), [0.5]))
    view = A.reported_view(m, 0.5)
    published = view.select(
        "dataset",
        "backend",
        "config_id",
        F.round("precision", 4).alias("precision"),
        (F.round("recall", 4) + F.when(F.col("config_id") == "B0", 0.001).otherwise(0.0)).alias("recall"),
    )
    return rounded(A.table_crosscheck(m, published))


_RUNPOOL = f"""prim as (select dataset, backend, config_id, count(distinct run) n_runs, sum(n_units)::bigint n_units, sum(n_correct)::bigint n_correct,
  sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(n_pred)::bigint n_pred, sum(n_exact)::bigint n_exact,
  sum(n_normalized)::bigint n_normalized, sum(n_fuzzy)::bigint n_fuzzy, sum(n_rejected)::bigint n_rejected,
  sum(exact_span_matches)::bigint exact_span_matches, sum(sum_best_iou) sum_best_iou from master where tau = 0.5 and round = 1 group by all),
pm as (select *, {METRICS}, {RATES} from prim)"""


def _primary(spark, sf):
    return R.pooled_over_runs(E.master_results(scores(spark, sf), [0.5]))


@query(
    "performance_table",
    scored() + f", {MASTER}, {_RUNPOOL} select dataset, backend, n_runs, n_units, n_correct, tp, fp, fn, n_pred, n_rejected, printf('%.4f', n_correct::double / n_units) accuracy, {r6('f1')} f1 from pm where config_id in ('F', 'TB')",
)
def performance_table(spark, sf):
    pooled = materialize(_primary(spark, sf))
    shown = R.performance_table(pooled).select("dataset", "backend", "accuracy")
    f1 = pooled.filter(F.col("config_id") == "F").select("dataset", "backend", "f1")
    return rounded(R.performance_counts(pooled).join(shown, ["dataset", "backend"]).join(f1, ["dataset", "backend"]))


@query(
    "alignment_table",
    scored() + f", {MASTER}, {_RUNPOOL} select dataset, backend, config_id, exact_span_match_rate, mean_token_iou, recoverable_span_rate, rejected_span_rate, fuzzy_span_rate, \"precision\", recall, f1 from pm where config_id in ('F','A5','B0','A3')",
)
def alignment_table(spark, sf):
    return rounded(R.alignment_table(_primary(spark, sf)))


@query(
    "full_metrics_table",
    scored() + f", {MASTER}, {_RUNPOOL} select dataset, backend, config_id, case when dataset = 'pooled' then 9 else 5 end dataset_rank, n_units, accuracy, \"precision\", recall, f1 from pm",
)
def full_metrics_table(spark, sf):
    pooled = _primary(spark, sf)
    return rounded(pooled.select("dataset", "backend", "config_id", "dataset_rank", "n_units", *A.METRICS))


@query(
    "per_label_table",
    scored() + f""", {PER_LABEL}, every as (select {K}, tau, label, n_units, n_correct, tp, fp, fn from labsum
      union all select 'pooled', backend, config_id, run, round, tau, label, sum(n_units), sum(n_correct), sum(tp), sum(fp), sum(fn) from labsum
      group by backend, config_id, run, round, tau, label having count(distinct dataset) >= 2),
      s as (select dataset, backend, label, sum(n_units)::bigint n_units, sum(n_correct)::bigint n_correct, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn
      from every where tau = 0.5 and config_id = 'F' group by all)
      select dataset, backend, label, list_position({LABEL_LIST}, label) - 1 label_order, n_units units, {METRICS} from s""",
)
def per_label_table(spark, sf):
    counts = scores(spark, sf).counts(KEYS, [0.5])
    return rounded(R.per_label_table(E.label_metrics(counts, KEYS, [0.5], pooled=True)))


@query(
    "flagship_scoring_from_offsets",
    scored()
    + """, t as (select config_id, sum(n_units)::bigint n_units, sum(n_correct)::bigint n_correct, sum(tp)::bigint tp,
      sum(fp)::bigint fp, sum(fn)::bigint fn from review_counts group by all)
      select *, """
    + METRICS
    + " from t",
)
def flagship(spark, sf):
    """Predictions and gold as character offsets, mapped to token ranges, matched and scored."""
    docs = D.reviews(spark, sf)
    rows = D.reviews_with_spans(spark, sf).select("review_id", "dataset", F.posexplode("spans").alias("g_idx", "s"))
    gold = rows.select("review_id", "g_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.label").alias("label"))
    gold = with_token_ranges(gold, docs)
    s = score_records(D.records(spark, sf, gold_rows=gold.withColumns({"start": F.col("ts"), "end": F.col("tj")})))
    keys = ["config_id"]
    rows = E.with_prf(E.at_taus(s.counts(keys, [0.5], label=False), keys, [0.5]))
    return rounded(rows.select("config_id", "n_units", "n_correct", "tp", "fp", "fn", *A.METRICS))
