"""Tail probabilities for result rows (one per test), from the standard library only."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse normal distribution function by Newton steps on erfc."""
    z = 0.0
    for _ in range(200):
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        step = (0.5 * math.erfc(-z / math.sqrt(2)) - p) / max(density, 1e-300)
        z -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return z


def student_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def student_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_two_sided(mid, df) / 2 > 1 - p else (lo, mid)
    return (lo + hi) / 2


def _rows(fn, *series: pd.Series) -> pd.Series:
    return pd.Series(
        [None if any(pd.isna(v) for v in row) else float(fn(*row)) for row in zip(*series)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(lambda v, k: gamma_sf(k / 2.0, v / 2.0), x, df)


@F.pandas_udf(DoubleType())
def f_sf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rows(lambda v, a, b: beta_cdf(b / 2.0, a / 2.0, b / (b + a * v)) if v > 0 else 1.0, x, d1, d2)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rows(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(student_two_sided, t, df)


@F.pandas_udf(DoubleType())
def binom_half_cdf(k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X <= k) for n fair coin flips."""
    return _rows(lambda a, m: 1.0 if a >= m else beta_cdf(m - a, a + 1.0, 0.5), k, n)


@F.pandas_udf(DoubleType())
def binom_half_pmf(k: pd.Series, n: pd.Series) -> pd.Series:
    return _rows(
        lambda a, m: math.exp(math.lgamma(m + 1) - math.lgamma(a + 1) - math.lgamma(m - a + 1) - m * math.log(2)), k, n
    )
