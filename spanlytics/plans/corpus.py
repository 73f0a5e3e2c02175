"""Queries on records, text, units and corpus statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanlytics.functions import text as X
from spanlytics.functions.core import stable_hash
from spanlytics.functions.labels import ALIASES, LABELS, canonical_label
from spanlytics.functions.tokens import token_set
from spanlytics.operators import units as U
from spanlytics.operators.align import snap_to_tokens, token_rows, with_token_ranges
from spanlytics.plans import derived as D
from spanlytics.plans.derived_sql import Q, REVIEWS, SPAN_TEXT, TOKENS, gold_prefix, h, spans_prefix
from spanlytics.plans.registry import query
from spanlytics.session import materialize, shared_folder
from spanlytics.sources import records as REC
from spanlytics.sources import runs as RUN

# ----------------------------------------------------------------------- labels and records

_ALIAS = ", ".join(f"('{k}','{v}')" for k, v in ALIASES.items())
_VARIANTS = ["negative evidence", "Major-Claim 2", "Eval_neutral", " positive_claim_3 ", "CLAIM-NEG"]


def _raw_label(review_id, g_idx, label):
    pick = stable_hash(F.lit("v"), review_id, g_idx) % 8
    out = F.when(pick == 0, F.concat_ws("_", label, (g_idx % 5 + 1).cast("string"))).when(pick == 1, F.lower(label)).when(pick == 2, label)
    for i, v in enumerate(_VARIANTS):
        out = out.when(pick == i + 3, F.lit(v))
    return out


RAW = f"""raws as (select *, {h("'v'", 'review_id', 'g_idx')} % 8 v from gold),
raw as (select *, case v when 0 then label || '_' || (g_idx % 5 + 1) when 1 then lower(label) when 2 then label
  {' '.join(f"when {i + 3} then '{v}'" for i, v in enumerate(_VARIANTS))} end raw from raws),
canon as (select r.*, a.canon, try_cast(nullif(regexp_extract(trim(raw), '[_\\-\\s]?(\\d+)$', 1), '') as bigint) occurrence
  from raw r left join (values {_ALIAS}) a(k, canon)
  on a.k = replace(replace(lower(trim(regexp_replace(trim(raw), '[_\\-\\s]?\\d+$', ''))), '-', '_'), ' ', '_'))"""


@query("canonical_labels", gold_prefix(RAW) + " select raw, canon label, occurrence, count(*) n from canon group by all")
def canonical_labels(spark, sf):
    raw = D.gold(spark, sf).select(_raw_label(F.col("review_id"), F.col("g_idx"), F.col("label")).alias("raw"))
    counted = raw.groupBy("raw").agg(F.count("*").alias("n"))
    return counted.select("raw", canonical_label("raw").alias("c"), "n").select("raw", "c.label", "c.occurrence", "n")


TRIM = r"""wide as (select *, greatest(c_start - 1, 0) w0, least(c_end + 1, length(text)) w1
  from (select s.*, r.text from spans s join reviews r using (review_id))),
trimmed as (select review_id, g_idx,
  w0 + length(substr(text, w0 + 1, w1 - w0)) - length(regexp_replace(substr(text, w0 + 1, w1 - w0), '^\s+', '')) start_,
  w1 - (length(substr(text, w0 + 1, w1 - w0)) - length(regexp_replace(substr(text, w0 + 1, w1 - w0), '\s+$', ''))) end_ from wide)"""


def _wide(spark, sf):
    """Gold spans widened by one character on both sides, so many take in whitespace."""
    r = D.reviews_with_spans(spark, sf)
    wide = F.transform(
        "spans",
        lambda s: F.struct(
            F.greatest(s["start"] - 1, F.lit(0)).alias("start"),
            F.least(s["end"] + 1, F.length("text")).alias("end"),
            s["label"].alias("label"),
        ),
    )
    return r.withColumn("spans", wide)


@query("gold_spans_trimmed", spans_prefix(TRIM) + ' select review_id, g_idx, start_ "start", end_ "end" from trimmed')
def gold_spans_trimmed(spark, sf):
    cut = F.transform("spans", lambda s: REC.trim_span("text", s["start"], s["end"]))
    rows = _wide(spark, sf).select("review_id", F.posexplode(cut).alias("g_idx", "s"))
    return rows.select("review_id", "g_idx", "s.start", "s.end")


@query(
    "records_roundtrip",
    spans_prefix(TRIM, RAW)
    + """ select c.review_id::varchar review_id, 'corpus' dataset, t.start_ "start", t.end_ "end", c.canon "label", c.occurrence, c.raw raw_label
      from canon c join trimmed t using (review_id, g_idx) where c.canon is not null""",
)
def records_roundtrip(spark, sf):
    """Release-layout JSON lines written to the shared folder and read back with gold clean-up."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    wide = _wide(spark, sf)
    label = F.transform(
        "spans",
        lambda s, i: F.array(
            s["start"].cast("string"), s["end"].cast("string"), _raw_label(F.col("review_id"), i.cast("bigint"), s["label"])
        ),
    )
    wide.select(F.col("review_id").alias("id"), F.col("text").alias("review"), label.alias("label"), F.lit("r1").alias("rid")).write.json(path)
    back = REC.read_records(spark, path, "corpus")
    rows = back.filter(F.col("metadata")["rid"] == "r1").select("review_id", "dataset", F.inline("spans"))
    return rows.select("review_id", "dataset", "start", "end", "label", F.col("occurrence").cast("bigint").alias("occurrence"), "raw_label")


@query(
    "run_layout",
    "select dataset, 'a_b_c' backend_slug, count(*) n from (select lang dataset from documents) where dataset in ('en', 'de') group by all",
)
def run_layout(spark, sf):
    """Predictions written by run key and read back for two datasets only."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = D.reviews(spark, sf).select(
        "review_id", "dataset", F.lit("a:b/c").alias("backend"), F.lit("F").alias("config_id"), F.lit(0).alias("run"), F.lit(1).alias("round")
    )
    RUN.write_run(rows, path)
    return RUN.read_runs(spark, path, ["en", "de"]).groupBy("dataset", "backend_slug").agg(F.count("*").alias("n"))


@query(
    "record_files",
    gold_prefix()
    + """, n as (select r.review_id, r.dataset, count(g_idx) spans, count(g_idx) filter (g_idx % 2 = 0) even
      from (select doc_id review_id, lang dataset from documents) r left join gold g using (review_id) group by all),
    every as (select 'x' annotator, 'own' dataset, 'p-' || review_id id, spans, null::varchar split from n
      union all select 'y', 'own', 'p-' || review_id, even, null::varchar from n
      union all select 'split', 'test-set', 's-test-' || review_id, spans, 'test' from n)
    select annotator, dataset, split, count(*) n, sum(spans)::bigint n_spans, min(id) first_id, max(id) last_id from every group by all""",
)
def record_files(spark, sf):
    """Records written in the canonical layout, read back as two annotators and as a named split."""
    path = f"{shared_folder(spark)}/annotated-{uuid.uuid4().hex}"
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    records = D.reviews_with_spans(spark, sf).select(
        F.col("review_id").cast("string").alias("review_id"), "dataset", "text", spans.alias("spans"), F.create_map().cast("map<string,string>").alias("metadata")
    )
    REC.write_records(records, f"{path}/x")
    REC.write_records(records.withColumn("spans", F.filter("spans", lambda s, i: i % 2 == 0)), f"{path}/y")
    both = REC.read_annotators(spark, {"y": f"{path}/y", "x": f"{path}/x"}, "own", "p")
    split = REC.read_split(spark, f"{path}/x", "test-set", "test", "corpus", "s").withColumn("annotator", F.lit("split"))
    rows = both.unionByName(split.select(*both.columns)).withColumn("split", F.col("metadata")["split"])
    return rows.groupBy("annotator", "dataset", "split").agg(
        F.count("*").alias("n"), F.sum(F.size("spans")).alias("n_spans"), F.min("review_id").alias("first_id"), F.max("review_id").alias("last_id")
    )


@query("first_reviews", "select doc_id review_id, lang dataset from documents order by doc_id limit 10")
def first_reviews(spark, sf):
    return REC.first_reviews(D.reviews(spark, sf).select("review_id", "dataset"), 10)


@query(
    "gold_stripped",
    "select lang dataset, count(*) n, 0::bigint n_spans from documents group by all",
)
def gold_stripped(spark, sf):
    bare = REC.strip_gold(D.reviews_with_spans(spark, sf))
    return bare.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("n_spans"))


# ----------------------------------------------------------------------- text


@query("token_offsets", f"with {REVIEWS}, {TOKENS} select review_id, tok_idx, s, e from tokens")
def token_offsets(spark, sf):
    return token_rows(D.reviews(spark, sf))


JIT = f"""jit as (select review_id, g_idx, greatest(0, c_start + {h("'a'", 'review_id', 'g_idx')} % 7 - 3) a,
  c_end + {h("'b'", 'review_id', 'g_idx')} % 7 - 3 b from spans),
cnt as (select j.review_id, j.g_idx, j.a, j.b, count(*) filter (t.e <= j.a) i, count(*) filter (t.s < j.b) n, count(*) filter (t.s < j.a) k,
  min(t.s) filter (t.e > j.a and t.s < j.b) s0, max(t.e) filter (t.e > j.a and t.s < j.b) e1
  from jit j join tokens t using (review_id) group by all)"""


def _jittered(spark, sf):
    rows = D.reviews_with_spans(spark, sf).select("review_id", F.posexplode("spans").alias("g_idx", "s"))
    return rows.select(
        "review_id",
        "g_idx",
        F.greatest(F.lit(0), F.col("s.start") + stable_hash(F.lit("a"), "review_id", "g_idx") % 7 - 3).cast("int").alias("start"),
        (F.col("s.end") + stable_hash(F.lit("b"), "review_id", "g_idx") % 7 - 3).cast("int").alias("end"),
    )


@query(
    "span_token_ranges",
    spans_prefix(JIT)
    + ' select review_id, g_idx, a "start", b "end", case when n > i then i else k end ts, case when n > i then n else k end tj from cnt',
)
def span_token_ranges(spark, sf):
    # ends may fall behind the text; the last bucket of a text covers them
    docs = D.reviews(spark, sf)
    spans = _jittered(spark, sf).join(docs.select("review_id", F.length("text").alias("n")), "review_id")
    inside = spans.withColumn("end_", F.least("end", "n")).select("review_id", "g_idx", "start", F.col("end_").alias("end"), F.col("end").alias("given"))
    return with_token_ranges(inside, docs).select("review_id", "g_idx", "start", F.col("given").alias("end"), "ts", "tj")


@query(
    "snapped_spans",
    spans_prefix(JIT) + ' select review_id, g_idx, case when n > i then s0 else a end "start", case when n > i then e1 else b end "end" from cnt',
)
def snapped_spans(spark, sf):
    docs = D.reviews(spark, sf)
    spans = _jittered(spark, sf).join(docs.select("review_id", F.length("text").alias("n")), "review_id")
    clipped = spans.select("review_id", "g_idx", "start", F.least("end", "n").alias("end"), F.col("end").alias("given"))
    ranged = with_token_ranges(clipped, docs)
    snapped = snap_to_tokens(ranged, token_rows(docs))
    some = F.col("tj") > F.col("ts")
    return snapped.select("review_id", "g_idx", "start", F.when(some, F.col("end")).otherwise(F.col("given")).alias("end"))


@query(
    "content_hash",
    """select doc_id, sha256(text) text_sha256,
      sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') record_sha256 from documents""",
)
def content_hash(spark, sf):
    d = D.table(spark, sf, "documents")
    record = X.sha256_json(doc_id="doc_id", lang="lang", source="source", n_chars="n_chars")
    return d.select("doc_id", X.sha256_text("text").alias("text_sha256"), record.alias("record_sha256"))


_SQUEEZED = r"""trim(regexp_replace(regexp_replace(replace(regexp_replace(html, '</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,200})?/?>', '', 'g'), '­', ''),
  '\s*[\r\n]\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10) || ' ')"""


@query("normalized_text", f"select page_id, sha256(t) text_sha256, length(t) n from (select page_id, {_SQUEEZED} t from pages)")
def normalized_text(spark, sf):
    rows = D.table(spark, sf, "pages").select("page_id", X.normalized("html").alias("m"))
    return rows.select("page_id", X.sha256_text("m.text").alias("text_sha256"), F.col("m.size").alias("n"))


@query("clean_text", f"select page_id, sha256(t) text_sha256 from (select page_id, {_SQUEEZED} t from pages)")
def clean_text(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", X.sha256_text(X.clean_text("html")).alias("text_sha256"))


@query("token_sets", gold_prefix() + " select review_id, g_idx, tj - ts n, list_sum(range(ts, tj))::bigint index_sum from gold")
def token_sets(spark, sf):
    """Token indices of every gold span as a set."""
    sets = D.gold(spark, sf).select("review_id", "g_idx", token_set("ts", "tj").alias("t"))
    total = F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sets.select("review_id", "g_idx", F.size("t").alias("n"), total.alias("index_sum"))


@query("normalized_offsets", spans_prefix() + ' select review_id, g_idx, c_start "start", c_end "end" from spans')
def normalized_offsets(spark, sf):
    """Gold spans mapped into the normalised text and back."""
    r = D.reviews_with_spans(spark, sf).withColumn("m", X.normalized("text"))
    there = r.select(
        "review_id", "m", F.transform("spans", lambda s: X.from_source("m", s["start"], s["end"])).alias("p")
    )
    back = there.select("review_id", F.posexplode(F.transform("p", lambda s: X.to_source("m", s["start"], s["end"]))).alias("g_idx", "s"))
    return back.select("review_id", "g_idx", "s.start", "s.end")


@query(
    "match_form",
    r"select doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) form_sha256 from documents",
)
def match_form(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.sha256_text(X.match_normalized("text")["text"]).alias("form_sha256"))


@query(
    "decoded_references",
    """select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;', '"', 'g'), '&nbsp;', chr(160), 'g'), '&amp;', '&', 'g') title
      from (select page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) t from pages)""",
)
def decoded_references(spark, sf):
    title = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    return D.table(spark, sf, "pages").select("page_id", X.decode_references(title).alias("title"))


@query(
    "shortened_text",
    r"""select doc_id, case when length(t) > 80 then substr(t, 1, 77) || '...' else t end short,
      trim(regexp_replace(regexp_replace(t, '^[\s"''“”‘’(\[\-–—.,;:]+', ''), '[\s"''“”‘’)\]\-–—]+$', '')) = t clean
      from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents)""",
)
def shortened_text(spark, sf):
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return D.table(spark, sf, "documents").select("doc_id", X.shorten("text").alias("short"), (X.strip_edges(flat) == flat).alias("clean"))


@query(
    "structure_flags",
    r"""select lang, count(*) n, count(*) filter (regexp_matches(text, '(?m)^\s*(?:\d+[.)]|[-*•])\s+')) numbered,
      count(*) filter (regexp_matches(text, '(?i)reviewer\s*#?\s*\d')) reviewer,
      count(*) filter (regexp_matches(text, '(?i)\b(round\s*\d|revised (?:version|manuscript)|resubmission|essential revisions)\b')) round from documents group by all""",
)
def structure_flags(spark, sf):
    f = X.structure_flags("text")
    return D.table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count_if(f["numbered_item"]).alias("numbered"),
        F.count_if(f["reviewer_header"]).alias("reviewer"),
        F.count_if(f["round_marker"]).alias("round"),
    )


# ----------------------------------------------------------------------- sentences and units

# Boundaries are marked in the text, soft wraps unmarked, and offsets summed over the pieces.
SENTENCES = r"""marked as (select review_id, dataset, text,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([.!?]["''”’)\]]*)(\s+)([A-Z0-9"''“(\[])', '\1' || chr(1) || '\2\3', 'g'),
    '(\n+)', '\1' || chr(2), 'g'),
    '([^.!?:;"''”’)\]\s][ \t]*\n+)' || chr(2) || '([\p{Ll}])', '\1\2', 'g'),
    '([^.!?:;"''”’)\]\s][ \t]*\n+)' || chr(2) || '([\p{Ll}])', '\1\2', 'g') m from reviews),
split as (select review_id, dataset, text, unnest(string_split(replace(m, chr(2), chr(1)), chr(1))) piece,
  generate_subscripts(string_split(replace(m, chr(2), chr(1)), chr(1)), 1) pos from marked),
off as (select *, coalesce(sum(length(piece)) over (partition by review_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint o from split),
sents as materialized (select review_id, dataset, row_number() over (partition by review_id order by pos) - 1 k,
  o + length(piece) - length(regexp_replace(piece, '^\s+', '')) s, o + length(regexp_replace(piece, '\s+$', '')) e,
  trim(piece, chr(10) || ' ' || chr(9)) sent from off where regexp_replace(piece, '\s+', '', 'g') <> '')"""


@query("sentences", f'with {REVIEWS}, {SENTENCES} select review_id, k, s "start", e "end" from sents')
def sentences(spark, sf):
    return U.sentences(D.reviews(spark, sf)).select("review_id", "k", "start", "end")


SENT_UNITS = """st as (select x.review_id, x.k, x.s, x.e, count(*) filter (t.e <= x.s) ts, count(*) filter (t.s < x.e) tj
  from sents x join tokens t using (review_id) group by all),
ov as (select st.review_id, st.k, g.label, g.g_idx, least(st.tj, g.tj) - greatest(st.ts, g.ts) ov
  from st join gold g on g.review_id = st.review_id and g.ts < st.tj and st.ts < g.tj),
lab as (select review_id, k, arg_max(label, (ov, -g_idx)) label from ov group by all)"""


@query(
    "sentence_units",
    spans_prefix(SENTENCES, SENT_UNITS)
    + " select st.review_id || '#s' || st.k unit_id, st.ts, st.tj, coalesce(lab.label, 'None') \"label\" from st left join lab using (review_id, k)",
)
def sentence_units(spark, sf):
    sents = materialize(U.ranged_sentences(D.reviews(spark, sf)))
    return U.label_sentences(sents, D.gold(spark, sf)).select("unit_id", "ts", "tj", "label")


@query(
    "context_windows",
    f"""with {REVIEWS}, {SENTENCES} select review_id, k, sha256(sent) text_sha, sha256(coalesce(string_agg(sent, ' ') over (partition by review_id order by k rows between 2 preceding and 1 preceding), '')) context_sha from sents""",
)
def context_windows(spark, sf):
    w = U.context_windows(D.reviews(spark, sf), 2)
    return w.select("review_id", "k", F.sha2("text", 256).alias("text_sha"), F.sha2("context", 256).alias("context_sha"))


@query(
    "gold_units",
    spans_prefix(SPAN_TEXT) + " select review_id || '#' || g_idx unit_id, dataset, c_start \"start\", c_end \"end\", label gold_label, sha256(span_text) text_sha from texted",
)
def gold_units(spark, sf):
    u = U.gold_units(D.reviews_with_spans(spark, sf))
    return u.select("unit_id", "dataset", "start", "end", "gold_label", F.sha2("text", 256).alias("text_sha"))


_LABN = ", ".join(f"count(g_idx) filter (label = '{x}') \"n_{x}\"" for x in LABELS)
_LABS = ", ".join(f"round_even(coalesce(\"n_{x}\"::double / nullif(total_units, 0), 0), 4) \"share_{x}\"" for x in LABELS)


@query(
    "corpus_statistics",
    spans_prefix()
    + f""", t as (select r.dataset, count(distinct r.review_id) total_reviews, count(s.g_idx) total_units, sum(s.tj - s.ts) tok, {_LABN},
      min(c_start) start_min, max(c_start) start_max, min(c_end) end_min, max(c_end) end_max from reviews r left join spans s using (review_id) group by r.dataset)
    select dataset, total_reviews, total_units, round_even(total_units::double / total_reviews, 2) avg_units_per_review,
      round_even(coalesce(tok::double / nullif(total_units, 0), 0), 2) avg_tokens_per_unit, {', '.join(f'"n_{x}"' for x in LABELS)}, {_LABS}, start_min, start_max, end_min, end_max from t""",
)
def corpus_statistics(spark, sf):
    return U.corpus_statistics(D.reviews_with_spans(spark, sf), ["dataset"])


DIGEST = """listed as (select review_id, count(*) n, string_agg(c_start || '-' || c_end || '-' || label, ';' order by g_idx) l from spans group by review_id),
dig as (select t.review_id, t.dataset, sha256(t.text) text_sha256, length(t.text) n_chars, coalesce(s.n, 0) n_gold_spans,
  sha256(t.review_id || chr(9) || sha256(t.text) || chr(9) || coalesce(s.l, '')) digest
  from reviews t left join listed s using (review_id))"""


@query("corpus_manifest", spans_prefix(DIGEST) + " select review_id, dataset, text_sha256, n_chars, n_gold_spans, digest from dig")
def corpus_manifest(spark, sf):
    return U.record_digest(D.reviews_with_spans(spark, sf))


@query(
    "dataset_hash",
    spans_prefix(DIGEST)
    + """, n0 as (select dataset, digest || ':' || count(*) hh, digest p from dig group by dataset, digest),
    n1 as (select dataset, substr(p, 1, 5) p, sha256(string_agg(hh, chr(10) order by hh)) hh from n0 group by dataset, substr(p, 1, 5)),
    n2 as (select dataset, substr(p, 1, 2) p, sha256(string_agg(hh, chr(10) order by hh)) hh from n1 group by dataset, substr(p, 1, 2))
    select dataset, sha256(string_agg(hh, chr(10) order by hh)) dataset_hash from n2 group by dataset""",
)
def dataset_hash(spark, sf):
    return U.dataset_hash(U.record_digest(D.reviews_with_spans(spark, sf)), ["dataset"])


@query(
    "corpus_profile",
    f"""with {REVIEWS}, {SENTENCES}, c as (select r.review_id, r.dataset, len(regexp_extract_all(r.text, '{Q}')) tokens,
      (select count(*) from sents s where s.review_id = r.review_id) sents, greatest(1, length(r.text) - length(replace(r.text, chr(10), '')) + 1) paras,
      regexp_matches(text, '(?m)^\\s*(?:\\d+[.)]|[-*•])\\s+')::int a, regexp_matches(text, '(?i)reviewer\\s*#?\\s*\\d')::int b,
      regexp_matches(text, '(?i)\\b(round\\s*\\d|revised (?:version|manuscript)|resubmission|essential revisions)\\b')::int c from reviews r)
    select dataset, count(*) n_records, round_even(avg(tokens), 1) mean_tokens, median(tokens) median_tokens, round_even(avg(sents), 1) mean_sentences,
      round_even(avg(paras), 1) mean_paragraphs, round_even(avg(a), 3) numbered_item_fraction, round_even(avg(b), 3) reviewer_header_fraction,
      round_even(avg(c), 3) round_marker_fraction,
      concat_ws(';', case when avg(b) > 0.2 or avg(c) > 0.2 then 'sections' end, case when avg(tokens) > 600 then 'long reports' end) notes
    from c group by dataset""",
)
def corpus_profile(spark, sf):
    return U.corpus_profile(D.reviews(spark, sf), ["dataset"])


_EX = """pool as (select s.review_id, length(r.text) n, s.labs from (select review_id, list_distinct(list(label)) labs from spans
  where review_id not in (select doc_id from labels) group by review_id having count(*) >= 2) s join reviews r using (review_id)),
e1 as (select *, 1 position from pool order by -len(labs), n, review_id limit 1),
e2 as (select p.*, 2 position from pool p, e1 where p.review_id <> e1.review_id
  order by -len(list_filter(p.labs, lambda x: not list_contains(e1.labs, x))), p.n, p.review_id limit 1),
e3 as (select p.*, 3 position from pool p, e1, e2 where p.review_id not in (e1.review_id, e2.review_id)
  order by -len(list_filter(p.labs, lambda x: not list_contains(list_concat(e1.labs, e2.labs), x))), p.n, p.review_id limit 1)"""


@query(
    "exemplar_selection",
    spans_prefix(_EX) + " select review_id, position from e1 union all select review_id, position from e2 union all select review_id, position from e3",
)
def exemplar_selection(spark, sf):
    rated = D.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    return U.select_exemplars(D.reviews_with_spans(spark, sf), rated).select("review_id", "position")


@query(
    "stratified_sample",
    f"select lang, doc_id from (select *, row_number() over (partition by lang order by {h('7', 'doc_id')}, doc_id) r from documents) where r <= 20",
)
def stratified_sample(spark, sf):
    docs = D.table(spark, sf, "documents").select("lang", "doc_id")
    return U.sample_per_group(docs, "lang", "doc_id", 20, seed=7)


@query(
    "grouped_split",
    f"""select doc_id, case when r <= greatest(1, floor(n * 0.1)) then 'val' else 'train' end part
      from (select doc_id, row_number() over (order by {h('0', 'doc_id')}, doc_id) r, count(*) over () n from documents)""",
)
def grouped_split(spark, sf):
    return U.grouped_split(D.table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, 0)
