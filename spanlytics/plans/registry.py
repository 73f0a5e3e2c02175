"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# Added before rounding on both sides, so that exact halves and values a hair below them agree.
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns so that summation order does not show."""
    return df.select(
        *[
            F.round(F.col(c) + F.lit(NUDGE), digits).alias(c) if t in {"double", "float"} else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r6(expr: str) -> str:
    return f"(round(({expr})::double + {NUDGE}::double, 6) + 0::double)"
