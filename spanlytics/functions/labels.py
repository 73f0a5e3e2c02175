"""Label domain and canonicalisation of label surface forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanlytics.functions.core import col

# The five-label scheme, in order.
LABELS = ["Eval_pos", "Eval_neg", "Jus_pos", "Jus_neg", "Major_Claim"]

# Lower-case surface forms accepted for each label.
ALIASES = {
    "eval_pos": "Eval_pos",
    "eval_neg": "Eval_neg",
    "jus_pos": "Jus_pos",
    "jus_neg": "Jus_neg",
    "major_claim": "Major_Claim",
    "majorclaim": "Major_Claim",
    "major claim": "Major_Claim",
    "positive_claim": "Eval_pos",
    "negative_claim": "Eval_neg",
    "positive_evidence": "Jus_pos",
    "negative_evidence": "Jus_neg",
    "claim_pos": "Eval_pos",
    "claim_neg": "Eval_neg",
    "evidence_pos": "Jus_pos",
    "evidence_neg": "Jus_neg",
}

NONE = "None"
RECOVERED = ["exact", "normalized", "fuzzy"]


def label_at(ordinal) -> Column:
    """Label name for a 0-based ordinal."""
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (col(ordinal) + 1).cast("int"))


def label_order(name) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), col(name)) - 1


def canonical_label(raw) -> Column:
    """``struct<label, occurrence>``: a numeric suffix becomes the occurrence, the rest is mapped."""
    s = F.regexp_replace(col(raw), r"(?U)^\s+|\s+$", "")
    suffix = F.regexp_extract(s, r"(?U)[_\-\s]?(\d+)$", 1)
    stem = F.regexp_replace(s, r"(?U)[_\-\s]?\d+$", "")
    key = F.translate(F.lower(F.regexp_replace(stem, r"(?U)^\s+|\s+$", "")), "- ", "__")
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.struct(
        F.try_element_at(F.create_map(*pairs), key).alias("label"),
        F.nullif(suffix, F.lit("")).try_cast("bigint").alias("occurrence"),
    )


def is_recovered(status, start, end) -> Column:
    """A recovered span has a matching status and a non-empty range."""
    return F.coalesce(col(status).isin(RECOVERED) & (col(end) > col(start)), F.lit(False))


def scoring_status(status, label) -> Column:
    """Recovered spans whose label is outside the scheme are scored as ``illegal_label``."""
    legal = F.coalesce(col(label).isin(LABELS), F.lit(False))
    return F.when(col(status).isin(RECOVERED) & ~legal, F.lit("illegal_label")).otherwise(col(status))
