"""Small Column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_hash(*parts) -> Column:
    """32-bit hash of the parts joined by ``|``; literals are passed as ``F.lit``.

    The first eight hex digits of md5 give the same number in any SQL engine, so sampling and
    resampling are reproducible and can be checked outside Spark.
    """
    joined = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def digest(*parts) -> Column:
    """md5 of the parts joined by ``|``, to be cut into several small hashes."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))


def digest_part(md5, index: int) -> Column:
    """24-bit hash number ``index`` (0-4) of one md5."""
    return F.conv(F.substring(col(md5), 1 + 6 * index, 6), 16, 10).cast("bigint")


def ratio(num, den) -> Column:
    """``num / den``; NULL when the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio0(num, den) -> Column:
    """``num / den``; 0 when the denominator is zero."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def let(value, build) -> Column:
    """``build(value)`` with ``value`` evaluated once per row.

    Binding through a one-element array keeps the optimizer from copying a costly expression into
    every place that uses it, for instance into the body of a higher-order function.
    """
    return F.element_at(F.transform(F.array(col(value)), build), 1)


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def slice_text(text, start, end) -> Column:
    """Half-open, 0-based code-point slice."""
    text, start, end = col(text), col(start), col(end)
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def literal_rows(rows: list[tuple], names: list[str]) -> Column:
    """A literal ``array<struct>`` to explode, for small fixed grids (configs, taus, systems)."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])


def prf_columns(units="n_units", correct="n_correct", tp="tp", fp="fp", fn="fn") -> dict[str, Column]:
    """accuracy (NULL for no units), precision, recall, f1 (0 on empty denominators)."""
    tp, fp, fn = col(tp), col(fp), col(fn)
    p = ratio0(tp, tp + fp)
    r = ratio0(tp, tp + fn)
    return {
        "accuracy": ratio(correct, units),
        "precision": p,
        "recall": r,
        "f1": ratio0(2 * p * r, p + r),
    }


def with_prf(df, **names):
    return df.withColumns(prf_columns(**names))
