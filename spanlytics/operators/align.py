"""Recovering spans in their source documents, and character spans to token ranges.

Documents are long and spans are many, so a document's text never travels once per span: spans are
gathered in bounded chunks per document and each chunk meets the text once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from spanlytics.functions.approx import SpanSet, candidate_regions, codes, window_check
from spanlytics.functions.core import slice_text
from spanlytics.functions.fingerprints import Q, W, fingerprint_udf
from spanlytics.functions.labels import LABELS
from spanlytics.functions.locate import SIMILARITY, Source, folded, located, nearest_windows, region_texts, stripped
from spanlytics.functions.text import match_form_lists, match_normalized, strip_edges
from spanlytics.functions.tokens import in_slices, token_bounds, token_offsets
from spanlytics.session import materialize, task_count

CHUNK = 256
#: Spans of a document that are met at once where some need a fuzzy search.
FUZZY_CHUNK = 32
#: Characters of passages that are sent to every task at once.
BLOCK_CHARS = 1 << 22
BUCKET = 512

_INDEX = ArrayType(
    StructType(
        [
            StructField("bucket", IntegerType()),
            StructField("starts_before", IntegerType()),
            StructField("starts", ArrayType(IntegerType())),
            StructField("ends_before", IntegerType()),
            StructField("ends", ArrayType(IntegerType())),
        ]
    )
)


def _index_rows(text: pa.Array) -> pa.Array:
    rows = [token_bounds(t or "") + (len(t or ""),) for t in text.to_pylist()]
    counts = np.array([n // BUCKET + 1 for _, _, n in rows], dtype=np.int64)
    columns = {"bucket": [], "starts_before": [], "ends_before": []}
    sizes, values = {"starts": [], "ends": []}, {"starts": [], "ends": []}
    for (ts, te, _), k in zip(rows, counts):
        columns["bucket"].append(np.arange(k))
        edges = np.arange(k + 1) * BUCKET
        for name, arr in (("starts", ts), ("ends", te)):
            cut = np.searchsorted(arr, edges)
            columns[name + "_before"].append(cut[:-1])
            sizes[name].append(np.diff(cut))
            values[name].append(arr[: cut[-1]])

    def ints(parts):
        return pa.array(np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32))

    def lists(name):
        flat = np.concatenate(sizes[name]) if sizes[name] else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat)]).astype(np.int32)), ints(values[name]))

    kind = pa.list_(pa.int32())
    inner = pa.StructArray.from_arrays(
        [ints(columns["bucket"]), ints(columns["starts_before"]), lists("starts"), ints(columns["ends_before"]), lists("ends")],
        fields=[
            pa.field("bucket", pa.int32()),
            pa.field("starts_before", pa.int32()),
            pa.field("starts", kind),
            pa.field("ends_before", pa.int32()),
            pa.field("ends", kind),
        ],
    )
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), inner)


@F.arrow_udf(_INDEX)
def _token_index(text: pa.Array) -> pa.Array:
    return in_slices(_index_rows, text)


def token_index(docs: DataFrame) -> DataFrame:
    """Token bounds cut into buckets of ``BUCKET`` characters with the counts before each bucket."""
    return docs.select("review_id", F.inline(_token_index("text")))


def token_rows(docs: DataFrame) -> DataFrame:
    """One row per token: review_id, tok_idx, s, e. Offsets come with the row; nothing is shuffled."""
    tok = docs.select("review_id", token_offsets("text").alias("tok"))
    rows = tok.select("review_id", F.posexplode(F.arrays_zip("tok.s", "tok.e")).alias("tok_idx", "t"))
    return rows.select("review_id", "tok_idx", F.col("t.s").alias("s"), F.col("t.e").alias("e"))


def with_token_ranges(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``ts``/``tj`` for character spans by two equi-joins on (review, bucket).

    ``ts`` counts tokens ending at or before the start, ``tj`` tokens starting before the end; when
    no token is touched both are the insertion point.
    """
    index = token_index(docs)
    left = index.select("review_id", F.col("bucket").alias("b0"), *[F.col(c).alias("l_" + c) for c in index.columns[2:]])
    right = index.select("review_id", F.col("bucket").alias("b1"), *[F.col(c).alias("r_" + c) for c in index.columns[2:]])
    placed = spans.withColumns({"b0": F.expr(f"start div {BUCKET}"), "b1": F.expr(f"end div {BUCKET}")})
    joined = placed.join(left, ["review_id", "b0"]).join(right, ["review_id", "b1"])
    start, end = F.col("start"), F.col("end")
    first = F.col("l_ends_before") + F.size(F.filter("l_ends", lambda x: x <= start))
    last = F.col("r_starts_before") + F.size(F.filter("r_starts", lambda x: x < end))
    gap = F.col("l_starts_before") + F.size(F.filter("l_starts", lambda x: x < start))
    touched = joined.select(*spans.columns, first.alias("_i"), last.alias("_j"), gap.alias("_k"))
    some = F.col("_j") > F.col("_i")
    return touched.select(
        *spans.columns,
        F.when(some, F.col("_i")).otherwise(F.col("_k")).alias("ts"),
        F.when(some, F.col("_j")).otherwise(F.col("_k")).alias("tj"),
    )


def snap_to_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Widen spans to the tokens they touch (``ts``/``tj`` must be present)."""
    first = tokens.select("review_id", F.col("tok_idx").alias("ts"), F.col("s").alias("_s"))
    last = tokens.select("review_id", (F.col("tok_idx") + 1).alias("tj"), F.col("e").alias("_e"))
    some = F.col("tj") > F.col("ts")
    wide = spans.join(first, ["review_id", "ts"], "left").join(last, ["review_id", "tj"], "left")
    return wide.withColumns(
        {
            "start": F.when(some, F.col("_s")).otherwise(F.col("start")),
            "end": F.when(some, F.col("_e")).otherwise(F.col("end")),
        }
    ).select(*spans.columns)


def searchable(docs: DataFrame, mode: str = "full", tokens: bool = True) -> DataFrame:
    """The source texts with what the search needs, made once per document: size, matching form with its index map, tokens.

    The texts are dealt by the key of the join that follows, which needs that exchange anyway.
    """
    return _prepared(_sources(docs), mode, tokens)


def _sources(docs: DataFrame) -> DataFrame:
    return docs.select("review_id", F.coalesce("text", F.lit("")).alias("source")).repartition(task_count(docs.sparkSession), "review_id")


def _prepared(rows: DataFrame, mode: str, tokens: bool) -> DataFrame:
    rows = rows.withColumn("source_size", F.length("source"))
    if mode != "exact":
        rows = rows.withColumn("form", match_normalized("source"))
    return rows.withColumn("tok", token_offsets("source")) if tokens else rows


def _forms(form) -> Column:
    return F.array(form, F.trim(strip_edges(form)))


def _with_windows(rows: DataFrame, mode: str, threshold: float) -> DataFrame:
    """Rows of ``searchable`` texts and ``items``, ready for ``located``: mirrors, and windows of what is found in no other way."""
    rows = rows.withColumn("mirror", F.reverse("source"))
    if mode == "exact":
        return rows
    form = F.col("form")["text"]
    rows = rows.withColumn("form_mirror", F.reverse(form))
    if mode != "full":
        return rows

    def open_form(a):
        found = F.contains("source", a["needle"]) | F.contains(form, a["forms"][0]) | ((a["forms"][1] != "") & F.contains(form, a["forms"][1]))
        return F.when((a["needle"] != "") & ~found, a["forms"][0])

    rows = rows.withColumn("regions", candidate_regions(threshold)(form, F.transform("items", open_form)))
    wanted = F.transform("regions", lambda r: F.get(F.col("items"), r["i"])["forms"][0])
    rows = rows.withColumn("checked", window_check(threshold)(region_texts("form", "regions"), wanted))
    near = F.transform("items", lambda a, i: nearest_windows("form", "checked", "regions", i))
    joined = F.zip_with("items", near, lambda a, w: a.withField("similarity", w["similarity"]).withField("windows", w["windows"]))
    return rows.withColumn("items", joined).drop("regions", "checked")


def locate_spans(
    docs: DataFrame,
    spans: DataFrame,
    mode: str = "full",
    threshold: float = SIMILARITY,
    chunk: int = CHUNK,
    tokens: bool = True,
    counts: bool = True,
    number: str = "span_id",
    chunk_of: Column | None = None,
) -> DataFrame:
    """Locate independent spans in their own document.

    ``spans``: review_id, span_id (dense number within a review), text, hint. The dense number
    decides the chunk, so even a review with very many spans is split evenly. Where ``spans`` have a boolean
    ``verbatim``, those for which it is false are looked for in the matching form only.
    """
    part = chunk_of if chunk_of is not None else F.expr(f"cast({number} div {chunk if mode != 'full' else FUZZY_CHUNK} as bigint)")
    ready = spans.withColumn("needle", stripped(F.coalesce("text", F.lit(""))))
    marked = "verbatim" in spans.columns
    fields = ["needle", F.col("hint").cast("int").alias("hint"), *(["verbatim"] if marked else [])]
    if mode != "exact":
        ready = ready.withColumn("_form", match_normalized("needle")["text"])
        fields.append(_forms(F.col("_form")).alias("forms"))
    packed = ready.groupBy("review_id", part.alias("_chunk")).agg(F.collect_list(F.struct(number, "text", *fields)).alias("items"))
    # chunks of one review are searched in different tasks
    rows = packed.join(searchable(docs, mode, tokens), "review_id").repartition(task_count(docs.sparkSession), "review_id", "_chunk")
    rows = _with_windows(rows, mode, threshold)
    source = Source(tokens="tok" if tokens else None)
    hits = rows.select("review_id", F.inline(F.transform("items", lambda a: F.struct(a.alias("a"), located(a, source, mode=mode, counts=counts, marked=marked).alias("found")))))
    return hits.select("review_id", f"a.{number}", "a.text", "a.hint", "found.*")


def align_responses(
    responses: DataFrame,
    docs: DataFrame,
    mode: str = "full",
    threshold: float = SIMILARITY,
    check_labels: bool = True,
    allowed=tuple(LABELS),
    tokens: bool = True,
    counts: bool = True,
) -> DataFrame:
    """Locate the ordered annotations of each response; one row per response in and out.

    ``responses`` has ``annotations: array<struct<ord, text, label_raw, label, occurrence, hint, hint_end>>``.
    With ``check_labels`` only spans with an allowed label move the place where the next search starts.
    The responses of a review meet its text in one task; forms and tokens are made behind that join, so they are
    neither dealt nor sorted.
    """
    rows = _prepared(responses.join(_sources(docs), "review_id"), mode, tokens)
    needles = F.transform("annotations", lambda a: stripped(F.coalesce(a["text"], F.lit(""))))
    item = lambda a, needle: F.struct(needle.alias("needle"), a["hint"].cast("int").alias("hint"), a["label"].alias("label"))
    rows = rows.withColumn("items", F.zip_with("annotations", needles, item))
    if mode != "exact":
        rows = rows.withColumn("_forms", match_form_lists(F.transform("items", lambda a: a["needle"])))
        rows = rows.withColumn("items", F.zip_with("items", "_forms", lambda a, f: a.withField("forms", _forms(f)))).drop("_forms")
    rows = _with_windows(rows, mode, threshold)
    legal = F.array(*[F.lit(x) for x in allowed]) if allowed else F.array().cast("array<string>")
    carries = (lambda a: F.coalesce(F.array_contains(legal, a["label"]), F.lit(False))) if check_labels else None
    found = folded(F.col("items"), Source(tokens="tok" if tokens else None), mode, counts, carries)
    return rows.select(*responses.columns, "source", found.alias("found"))


def passage_candidates(docs: DataFrame, passages: DataFrame, min_chars: int = Q + W - 1) -> DataFrame:
    """(item_id, review_id) pairs that may hold a passage verbatim, by an equi-join on winnowed fingerprints.

    A verbatim passage has all its fingerprints in the document, so one of them is enough; the one found in
    the fewest documents is used. ``passages`` shorter than ``min_chars`` use single trigrams.
    """

    def side(df, key, q, w):
        return df.select(key, F.explode(fingerprint_udf(q, w)("text")).alias("fp"))

    def one(cond, q, w):
        wanted = side(passages.filter(cond), "item_id", q, w)
        seen = side(docs, "review_id", q, w)
        load = seen.join(wanted.select("fp").distinct(), "fp", "left_semi").groupBy("fp").count()
        best = wanted.join(load, "fp").groupBy("item_id").agg(F.min_by("fp", F.struct("count", "fp")).alias("fp"), F.count("*").alias("present"))
        total = wanted.groupBy("item_id").agg(F.count("*").alias("total"))
        wanted = best.join(total, "item_id").filter(F.col("present") == F.col("total")).select("item_id", "fp")
        return seen.join(wanted, "fp").select("item_id", "review_id").distinct()

    # no size is asked first: a side without passages joins nothing
    return one(F.length("text") >= min_chars, Q, W).unionByName(one(F.length("text") < min_chars, 3, 1))


def approximate_pairs(docs: DataFrame, passages: DataFrame, threshold: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, review_id) pairs of passages and the documents that may hold them within the allowed edits.

    The passages are the query set: they go out in blocks of about ``block_chars`` characters, each
    against all documents, with an index of their own (``SpanSet``). No pair within the edits is lost.
    The texts are dealt to the tasks of a shuffle first: a search takes long, and their files may be few.
    """
    spark = docs.sparkSession
    docs = docs.select("review_id", "text").repartition(task_count(spark), "review_id", "text")
    wanted = materialize(passages.select("item_id", match_normalized(stripped(F.coalesce("text", F.lit(""))))["text"].alias("form")).filter("form <> ''"))
    blocks = max(1, -(-(wanted.agg(F.sum(F.length("form"))).first()[0] or 0) // block_chars))
    texts = docs.select("review_id", match_normalized("text")["text"].alias("form"))
    texts = materialize(texts) if blocks > 1 else texts
    pairs = None
    for k in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item_id", "form"), F.lit(blocks)) == k).collect()
        held = spark.sparkContext.broadcast(([r["item_id"] for r in block], [r["form"] for r in block]))
        found = texts.mapInArrow(_block_search(held, threshold), f"item_id {wanted.schema['item_id'].dataType.simpleString()}, review_id {docs.schema['review_id'].dataType.simpleString()}")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def _block_search(held, threshold: float):
    def run(batches):
        ids, forms = held.value
        index = SpanSet([codes(f) for f in forms], threshold)
        for batch in batches:
            found = [(ids[i], key) for key, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in sorted({i for i, _, _ in index.regions(codes(form))})]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.array(ids).type if ids else pa.int64()), pa.array([r for _, r in found], batch.column(0).type)], names=["item_id", "review_id"])

    return run


def recover_passages(docs: DataFrame, passages: DataFrame, mode: str = "exact", threshold: float = SIMILARITY) -> DataFrame:
    """Locate passages whose document is unknown: candidates first, then the usual matching.

    Exact mode is complete for passages of at least three characters; the other modes for all windows that
    differ from the passage by at most ``1 - threshold`` of its characters (see ``approximate_pairs``).
    """
    passages = passages.withColumn("text", stripped("text"))
    pairs = materialize(passage_candidates(docs, passages) if mode == "exact" else approximate_pairs(docs, passages, threshold))
    # a document with very many passages is met in several chunks
    sizes = pairs.groupBy("review_id").agg(F.ceil(F.count("*") / F.lit(FUZZY_CHUNK)).alias("_n"))
    spans = pairs.join(passages.select("item_id", "text"), "item_id").join(sizes, "review_id").withColumn("hint", F.lit(None).cast("int"))
    # only texts that may hold a passage are made searchable
    held = docs.join(pairs.select("review_id").distinct(), "review_id", "left_semi")
    rows = locate_spans(held, spans, mode, threshold, number="item_id", chunk_of=F.pmod(F.xxhash64("item_id"), F.col("_n")))
    return rows.drop("text", "hint").filter(F.col("status") != "rejected")


def span_text(df: DataFrame, text="text") -> DataFrame:
    return df.withColumn("span_text", slice_text(text, "start", "end"))
