"""The derived inputs of ``spanlytics.plans.derived`` as SQL CTEs for the DuckDB comparison."""

from __future__ import annotations

from spanlytics.functions.tokens import TOKEN_PATTERN
from spanlytics.plans.derived import RUNS, STEP, SYSTEMS
from spanlytics.plans.registry import r6

LABEL_LIST = "['Eval_pos','Eval_neg','Jus_pos','Jus_neg','Major_Claim']"
LABEL_IN = "('Eval_pos','Eval_neg','Jus_pos','Jus_neg','Major_Claim')"
KEYS = "dataset, backend, config_id, run, round"
Q = TOKEN_PATTERN.replace("'", "''")


def h(*parts: str) -> str:
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8))::bigint"


def part(md5: str, index: int) -> str:
    return f"('0x'||substr({md5},{1 + 6 * index},6))::bigint"


def _systems(rounds) -> str:
    rows = [
        f"('{b}','{c}',{r},{rd},{drop if rd == 1 else drop // 2})"
        for rd in rounds
        for b, c, drop in SYSTEMS
        for r in RUNS
        if rd == 1 or c == "F"
    ]
    return "systems(backend, config_id, run, round, drop_pct) as (values " + ",".join(rows) + ")"


REVIEWS = "reviews as (select doc_id review_id, lang dataset, text from documents)"
COUNTS = f"counted as materialized (select review_id, dataset, len(regexp_extract_all(text, '{Q}')) n_tok from reviews)"
GOLD = f"""
slots as (
  select *, md5(concat_ws('|', 'g', review_id, k)) m
  from (select review_id, dataset, n_tok, unnest(range(0, n_tok // {STEP})) k from counted)),
gold as materialized (
  select review_id, dataset, n_tok,
    row_number() over (partition by review_id order by k) - 1 g_idx,
    {STEP}*k + {part("m", 1)} % 3 ts,
    least({STEP}*k + {part("m", 1)} % 3 + 8 + {part("m", 2)} % 16, n_tok) tj,
    {LABEL_LIST}[{h("'y'", "review_id", "k - k % 2")} % 5 + 1] "label"
  from slots where {part("m", 0)} % 3 <> 0)"""
TOKENS = f"""
pieces as (
  select review_id, unnest(regexp_extract_all(text, '{Q}|\\s+')) tok,
         generate_subscripts(regexp_extract_all(text, '{Q}|\\s+'), 1) pos from reviews),
placed as (
  select review_id, tok, pos, length(tok) n,
    coalesce(sum(length(tok)) over (partition by review_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint s
  from pieces),
tokens as materialized (
  select review_id, row_number() over (partition by review_id order by pos) - 1 tok_idx, s, s + n e, tok
  from placed where not regexp_full_match(tok, '\\s+'))"""
# two steps, so that the two token lookups are never joined with each other first
SPANS = """
begun as materialized (
  select g.*, a.s c_start from gold g join tokens a on a.review_id = g.review_id and a.tok_idx = g.ts),
spans as materialized (
  select g.*, b.e c_end from begun g join tokens b on b.review_id = g.review_id and b.tok_idx = g.tj - 1)"""
SPAN_TEXT = """
texted as (
  select s.*, substr(r.text, c_start + 1, c_end - c_start) span_text from spans s join reviews r using (review_id))"""


PRED = f"""
results as (select review_id, dataset, backend, config_id, run, round from reviews, systems),
drawn as (
  select *, md5(concat_ws('|', 'p', case when round = 2 then 'r2' else 'r1' end, backend, config_id, run, review_id, g_idx)) m
  from gold, systems),
moved as (
  select dataset, backend, config_id, run, round, review_id, g_idx p_idx,
    greatest(0, ts + {part("m", 2)} % 5 - 2) ts,
    least(n_tok, tj + {part("m", 3)} % 7 - 3) tj,
    case when {part("m", 4)} % 6 = 0 then 'Eval_pos' else label end label,
    {part("m", 1)} % 20 t
  from drawn where {part("m", 0)} % 100 >= drop_pct),
pred as materialized (
  select {KEYS}, review_id, p_idx,
    case when t <> 0 then ts end ts, case when t <> 0 then tj end tj, label,
    case when t = 0 then 'rejected' when t = 1 then 'illegal_label' when t <= 3 then 'fuzzy'
         when t <= 5 then 'normalized' else 'exact' end status
  from moved)"""
PAIRS = """
pairs as materialized (
  select p.dataset, p.backend, p.config_id, p.run, p.round, p.review_id, p.p_idx, g.g_idx,
    p.label p_label, g.label g_label,
    least(p.tj, g.tj) - greatest(p.ts, g.ts) ov,
    (least(p.tj, g.tj) - greatest(p.ts, g.ts))::double
      / ((p.tj - p.ts) + (g.tj - g.ts) - (least(p.tj, g.tj) - greatest(p.ts, g.ts))) iou,
    (p.label = g.label and p.ts = g.ts and p.tj = g.tj) exact
  from pred p join gold g on p.review_id = g.review_id and p.ts < g.tj and g.ts < p.tj
  where p.status in ('exact','normalized','fuzzy') and p.tj > p.ts)"""
UNITS = f"""
best as (
  select {KEYS}, review_id, g_idx, arg_max(p_label, (ov, iou, -p_idx)) pred_label, max(iou) best_iou, max(exact::int) exact
  from pairs group by all),
units as materialized (
  select r.dataset, r.backend, r.config_id, r.run, r.round, r.review_id, g.g_idx,
    r.review_id || '#' || g.g_idx unit_id, g.label gold_label, b.pred_label,
    coalesce(b.best_iou, 0) best_iou, coalesce(b.exact, 0) exact,
    coalesce(b.pred_label = g.label, false)::int correct
  from results r join gold g on g.review_id = r.review_id
  left join best b on b.backend = r.backend and b.config_id = r.config_id and b.run = r.run and b.round = r.round
    and b.review_id = r.review_id and b.g_idx = g.g_idx)"""
# Greedy matching: pairs of one (run, review, label) are cut into islands of touching spans, ranked,
# and walked in rank order with the lists of used predictions and gold spans.
MATCHES = f"""
edges as (
  select q.*, least(p.ts, g.ts) lo, greatest(p.tj, g.tj) hi
  from pairs q
  join gold g on g.review_id = q.review_id and g.g_idx = q.g_idx
  join pred p on p.backend = q.backend and p.config_id = q.config_id and p.run = q.run and p.round = q.round
    and p.review_id = q.review_id and p.p_idx = q.p_idx
  where q.p_label = q.g_label),
cuts as (
  select *, case when lo < max(hi) over (partition by {KEYS}, review_id, g_label order by lo, hi, p_idx, g_idx
      rows between unbounded preceding and 1 preceding) then 0 else 1 end cut from edges),
isles as (
  select *, sum(cut) over (partition by {KEYS}, review_id, g_label order by lo, hi, p_idx, g_idx
      rows unbounded preceding) isle from cuts),
ranked as materialized (
  select *, row_number() over (partition by {KEYS}, review_id, g_label, isle order by iou desc, p_idx, g_idx) rn
  from isles),
walk as (
  select {KEYS}, review_id, g_label, isle, rn, p_idx, g_idx, iou, true taken, [p_idx] up, [g_idx] ug
  from ranked where rn = 1
  union all
  select r.dataset, r.backend, r.config_id, r.run, r.round, r.review_id, r.g_label, r.isle, r.rn, r.p_idx, r.g_idx, r.iou,
    not (list_contains(w.up, r.p_idx) or list_contains(w.ug, r.g_idx)),
    case when list_contains(w.up, r.p_idx) or list_contains(w.ug, r.g_idx) then w.up else list_append(w.up, r.p_idx) end,
    case when list_contains(w.up, r.p_idx) or list_contains(w.ug, r.g_idx) then w.ug else list_append(w.ug, r.g_idx) end
  from walk w join ranked r on r.backend = w.backend and r.config_id = w.config_id and r.run = w.run and r.round = w.round
    and r.review_id = w.review_id and r.g_label = w.g_label and r.isle = w.isle and r.rn = w.rn + 1),
matches as materialized (
  select {KEYS}, review_id, g_label, p_idx, g_idx, iou from walk where taken)"""


def tau_sql(taus) -> str:
    return "taus(tau) as (values " + ",".join(f"({t}::double)" for t in taus) + ")"


METRICS = f"""
    case when n_units > 0 then {r6("n_correct::double / n_units")} end accuracy,
    {r6("coalesce(tp::double / nullif(tp + fp, 0), 0)")} "precision",
    {r6("coalesce(tp::double / nullif(tp + fn, 0), 0)")} recall,
    {r6("coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)")} f1"""


def review_counts_sql(taus=(0.5,)) -> str:
    """CTEs ending in ``review_counts`` (one row per run, review, tau)."""
    return f"""{tau_sql(taus)},
per_pred as (select {KEYS}, review_id, count(*) n_pred,
    count(*) filter (status in ('exact','normalized','fuzzy') and tj > ts) n_scored,
    count(*) filter (status = 'exact') n_exact, count(*) filter (status = 'normalized') n_normalized,
    count(*) filter (status = 'fuzzy') n_fuzzy, count(*) filter (status = 'rejected') n_rejected,
    count(*) filter (status = 'illegal_label') n_illegal
  from pred group by all),
per_unit as (select {KEYS}, review_id, count(*) n_units, sum(correct)::bigint n_correct,
    sum(best_iou) sum_best_iou, sum(exact)::bigint exact_span_matches from units group by all),
per_match as (select {KEYS}, review_id, tau, count(*) tp from matches, taus where iou >= tau group by all),
review_counts as materialized (
  select r.dataset, r.backend, r.config_id, r.run, r.round, r.review_id, t.tau,
    coalesce(n_units, 0) n_units, coalesce(n_correct, 0) n_correct, coalesce(tp, 0) tp,
    coalesce(n_scored, 0) - coalesce(tp, 0) + coalesce(n_illegal, 0) + coalesce(n_rejected, 0) fp,
    coalesce(n_units, 0) - coalesce(tp, 0) fn,
    coalesce(n_pred, 0) n_pred, coalesce(n_exact, 0) n_exact, coalesce(n_normalized, 0) n_normalized,
    coalesce(n_fuzzy, 0) n_fuzzy, coalesce(n_rejected, 0) n_rejected, coalesce(n_illegal, 0) n_illegal,
    coalesce(exact_span_matches, 0) exact_span_matches, coalesce(sum_best_iou, 0) sum_best_iou
  from results r cross join taus t
  left join per_pred p using (dataset, backend, config_id, run, round, review_id)
  left join per_unit u using (dataset, backend, config_id, run, round, review_id)
  left join per_match m using (dataset, backend, config_id, run, round, review_id, tau))"""


SUM_COLUMNS = """count(*) n_reviews, sum(n_units)::bigint n_units, sum(n_correct)::bigint n_correct, sum(tp)::bigint tp,
    sum(fp)::bigint fp, sum(fn)::bigint fn, sum(n_pred)::bigint n_pred, sum(n_exact)::bigint n_exact,
    sum(n_normalized)::bigint n_normalized, sum(n_fuzzy)::bigint n_fuzzy, sum(n_rejected)::bigint n_rejected,
    sum(n_illegal)::bigint n_illegal, sum(exact_span_matches)::bigint exact_span_matches, sum(sum_best_iou) sum_best_iou"""


def scored(rounds=(1,), taus=(0.5,)) -> str:
    """``with recursive`` prefix up to ``review_counts``."""
    return "with recursive " + ",\n".join(
        [_systems(rounds), REVIEWS, COUNTS, GOLD, PRED, PAIRS, UNITS, MATCHES, review_counts_sql(taus)]
    )


def spans_prefix(*more: str) -> str:
    return "with recursive " + ",\n".join([REVIEWS, COUNTS, GOLD, TOKENS, SPANS, *more])


def gold_prefix(*more: str) -> str:
    return "with recursive " + ",\n".join([REVIEWS, COUNTS, GOLD, *more])


def pred_prefix(rounds=(1,), *more: str) -> str:
    return "with recursive " + ",\n".join([_systems(rounds), REVIEWS, COUNTS, GOLD, PRED, *more])


def pairs_prefix(rounds=(1,), *more: str) -> str:
    return pred_prefix(rounds, PAIRS, *more)


def units_prefix(rounds=(1,), *more: str) -> str:
    return pairs_prefix(rounds, UNITS, *more)
