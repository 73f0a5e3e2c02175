"""Regressions whose passes over the data are sums: negative binomial, quantile, penalised linear.

Every iteration maps batches to small sums (p x p) inside the tasks and adds them up; only those
sums reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanlytics.functions.core import stable_hash
from spanlytics.functions.tails import normal_quantile, normal_two_sided, student_quantile, student_two_sided
from spanlytics.operators.ranks import percentiles

MAX_LEVELS = 500
TAUS = (0.25, 0.5, 0.75, 0.9)


def _plain(table: list[tuple]) -> list[tuple]:
    """Numpy scalars as Python numbers."""
    return [tuple(v.item() if isinstance(v, np.generic) else v for v in row) for row in table]


def design(df: DataFrame, features: list[str], y: str, year: str | None = "year") -> tuple[DataFrame, list[str]]:
    """Intercept, features and year dummies (first year left out) as double columns; complete rows only."""
    rows = df.dropna(subset=[*features, y, *([year] if year else [])])
    levels = []
    if year:
        levels = [r[0] for r in rows.select(year).distinct().limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{year} has more than {MAX_LEVELS} levels")
    dummies = sorted(levels)[1:]
    names = ["Intercept", *[f"C({year})[T.{v}]" for v in dummies], *features]
    cols = [F.lit(1.0), *[(F.col(year) == v).cast("double") for v in dummies], *[F.col(f).cast("double") for f in features]]
    return rows.select(F.col(y).cast("double").alias("y"), F.array(*cols).alias("x")), names


def summed(rows: DataFrame, fn) -> np.ndarray:
    """Sum of ``fn(X, y) -> vector`` over all batches; batches of a task are added up before the shuffle."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                part = fn(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    sums = rows.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])


def _nb_pass(beta: np.ndarray, alpha: float):
    """Log-likelihood, gradient and Hessian in (beta, alpha) of the NB2 model."""

    def fn(x, y):
        mu = np.exp(np.clip(x @ beta, -30, 30))
        am = 1 + alpha * mu
        top = int(y.max()) if len(y) else 0
        j = np.arange(top)
        upto = lambda terms: np.concatenate([[0.0], np.cumsum(terms)])[y.astype(int)]
        logfact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])[y.astype(int)]
        ll = upto(np.log1p(alpha * j)) - logfact + y * np.log(mu) - (y + 1 / alpha) * np.log(am)
        gb = x.T @ ((y - mu) / am)
        ga = upto(j / (1 + alpha * j)) + np.log(am) / alpha**2 - (y + 1 / alpha) * mu / am
        hbb = -(x.T * (mu * (1 + alpha * y) / am**2)) @ x
        hba = -x.T @ (mu * (y - mu) / am**2)
        haa = (
            -upto((j / (1 + alpha * j)) ** 2) - 2 * np.log(am) / alpha**3 + 2 * mu / (alpha**2 * am)
            + (y + 1 / alpha) * mu**2 / am**2
        )
        return np.concatenate([[len(y), ll.sum()], gb, [ga.sum()], hbb.ravel(), hba, [haa.sum()]])

    return fn


def _unpack(v: np.ndarray, p: int):
    n, ll, g = v[0], v[1], v[2 : 3 + p]
    rest = v[3 + p :]
    h = np.zeros((p + 1, p + 1))
    h[:p, :p] = rest[: p * p].reshape(p, p)
    h[:p, p] = h[p, :p] = rest[p * p : p * p + p]
    h[p, p] = rest[-1]
    return n, ll, g, h


def nb_regression(df: DataFrame, features: list[str], y: str, year: str | None = "year", max_iter: int = 50, tol: float = 1e-8) -> DataFrame:
    """NB2 regression with estimated dispersion: one row per parameter.

    Newton steps on (beta, log alpha); a step that lowers the likelihood is halved.
    """
    rows, names = design(df, features, y, year)
    p = len(names)
    stats = rows.agg(F.avg("y").alias("m"), F.var_samp("y").alias("v")).first()
    beta = np.zeros(p)
    beta[0] = math.log(max(stats["m"], 1e-8))
    alpha = max(((stats["v"] or 0.0) - stats["m"]) / max(stats["m"], 1e-8) ** 2, 0.1)
    n, ll, g, h = _unpack(summed(rows, _nb_pass(beta, alpha)), p)
    for _ in range(max_iter):
        scale = np.ones(p + 1)
        scale[p] = alpha
        gl, hl = g * scale, h * np.outer(scale, scale)
        hl[p, p] += g[p] * alpha
        values, vectors = np.linalg.eigh(-hl)
        step = vectors @ ((vectors.T @ gl) / np.maximum(np.abs(values), 1e-10))
        if float(gl @ step) < tol:
            break
        size = 1.0
        while True:
            b2, a2 = beta + size * step[:p], alpha * math.exp(float(np.clip(size * step[p], -3, 3)))
            n, ll2, g2, h2 = _unpack(summed(rows, _nb_pass(b2, a2)), p)
            if ll2 >= ll - 1e-12 or size < 1e-6:
                break
            size /= 2
        beta, alpha, ll, g, h = b2, a2, ll2, g2, h2
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(-h)), 0))
    z = normal_quantile(0.975)
    table = []
    for name, coef, s in zip([*names, "alpha"], [*beta, alpha], se):
        stat = coef / s if s > 0 else math.nan
        table.append((name, float(coef), float(s), float(stat), normal_two_sided(stat), float(coef - z * s), float(coef + z * s), math.exp(coef), float(ll), float(2 * (p + 1) - 2 * ll), int(n)))
    return df.sparkSession.createDataFrame(
        _plain(table), "name string, coef double, se double, z double, p double, ci_low double, ci_high double, irr double, llf double, aic double, n long"
    )


def quantile_regression(
    df: DataFrame, features: list[str], y: str, taus=TAUS, year: str | None = "year", max_iter: int = 200, tol: float = 1e-6
) -> DataFrame:
    """Quantile regression by reweighted least squares, all quantiles in the same passes.

    Standard errors use the kernel sandwich with the Hall-Sheather bandwidth.
    """
    rows, names = design(df, features, y, year)
    p, k = len(names), len(taus)
    beta = [np.zeros(p) for _ in taus]

    def weighted(betas):
        def fn(x, yy):
            out = []
            for t, b in zip(taus, betas):
                r = yy - x @ b
                w = np.where(r > 0, t, 1 - t) / np.maximum(np.abs(r), 1e-6)
                xw = x.T * w
                out += [(xw @ x).ravel(), xw @ yy]
            return np.concatenate(out)

        return fn

    first = summed(rows, lambda x, yy: np.concatenate([(x.T @ x).ravel(), x.T @ yy, [len(yy)]]))
    xtx, n = first[: p * p].reshape(p, p), first[-1]
    beta = [np.linalg.pinv(xtx) @ first[p * p : p * p + p]] * k
    for _ in range(max_iter):
        parts = summed(rows, weighted(beta)).reshape(k, p * p + p)
        fresh = [np.linalg.pinv(v[: p * p].reshape(p, p)) @ v[p * p :] for v in parts]
        moved = max(float(np.abs(a - b).max()) for a, b in zip(fresh, beta))
        beta = fresh
        if moved < tol:
            break
    def fitted(b):
        return F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in b]), lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)

    residuals = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("y") - fitted(b)).alias("r")) for i, b in enumerate(beta)])
    quartiles = percentiles(rows.select(F.inline(residuals)), ["i"], "r", [0.25, 0.75])
    iqrs = {r["i"]: r["iqr"] for r in quartiles.groupBy("i").agg((F.max("value") - F.min("value")).alias("iqr")).collect()}  # a row for each quantile
    sd = rows.agg(F.stddev_pop("y")).first()[0]
    z = normal_quantile(0.975)
    widths = []
    for i, t in enumerate(taus):
        q = normal_quantile(t)
        density = math.exp(-q * q / 2) / math.sqrt(2 * math.pi)
        h = n ** (-1 / 3) * z ** (2 / 3) * (1.5 * density**2 / (2 * q * q + 1)) ** (1 / 3)
        low, high = max(t - h, 1e-6), min(t + h, 1 - 1e-6)
        widths.append(max(min(sd, iqrs[i] / 1.34) * (normal_quantile(high) - normal_quantile(low)), 1e-9))

    def kernel(x, yy):
        out = []
        for b, h in zip(beta, widths):
            u = (yy - x @ b) / h
            e = yy - x @ b
            out += [[np.where(np.abs(u) <= 1, 0.75 * (1 - u * u), 0.0).sum()], (x.T * (e > 0) @ x).ravel()]
        return np.concatenate(out)

    sums = summed(rows, kernel).reshape(k, 1 + p * p)
    inv = np.linalg.pinv(xtx)
    df_resid = n - p
    crit = student_quantile(0.975, df_resid)
    table = []
    for t, b, h, v in zip(taus, beta, widths, sums):
        f0 = v[0] / (n * h)
        above = v[1:].reshape(p, p)
        middle = (t / f0) ** 2 * above + ((1 - t) / f0) ** 2 * (xtx - above)
        se = np.sqrt(np.maximum(np.diag(inv @ middle @ inv), 0))
        for name, coef, s in zip(names, b, se):
            if name in features:
                stat = coef / s if s > 0 else math.inf
                table.append((float(t), name, float(coef), float(coef - crit * s), float(coef + crit * s), student_two_sided(stat, df_resid)))
    return df.sparkSession.createDataFrame(_plain(table), "tau double, feature string, coef double, ci_low double, ci_high double, p double")


# ----------------------------------------------------------------- penalised linear models


def _descend(gram: np.ndarray, xy: np.ndarray, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent for min 1/2 b'Gb - b'c + l1 |b| + l2/2 b'b on a small Gram matrix."""
    rows, target, b = gram.tolist(), xy.tolist(), start.tolist()
    for _ in range(300):
        change = 0.0
        for j, row in enumerate(rows):
            rho = target[j] - sum(g * v for g, v in zip(row, b)) + row[j] * b[j]
            scale = row[j] + l2
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / scale if scale > 0 else 0.0
            change = max(change, abs(new - b[j]))
            b[j] = new
        if change < 1e-5:
            break
    return np.array(b)


class _Sums:
    """Sufficient statistics of a set of rows; folds are added and subtracted."""

    def __init__(self, v: np.ndarray, p: int):
        self.v, self.p = v, p
        self.n = v[0]
        self.x, self.y, self.yy = v[1 : 1 + p], v[1 + p], v[2 + p]
        self.xy, self.xx = v[3 + p : 3 + 2 * p], v[3 + 2 * p :].reshape(p, p)

    def __add__(self, other):
        return _Sums(self.v + other.v, self.p)

    def centred(self):
        gram = self.xx / self.n - np.outer(self.x, self.x) / self.n**2
        return gram, self.xy / self.n - self.x * self.y / self.n**2

    def intercept(self, b):
        return (self.y - self.x @ b) / self.n

    def sse(self, b, b0):
        return self.yy - 2 * (b @ self.xy + b0 * self.y) + b @ self.xx @ b + 2 * b0 * (b @ self.x) + self.n * b0 * b0


def _path(train: _Sums, alphas: np.ndarray, ratio: float) -> list[np.ndarray]:
    gram, xy = train.centred()
    b, out = np.zeros(train.p), []
    for a in alphas:
        b = _descend(gram, xy, a * ratio, a * (1 - ratio), b)
        out.append(b)
    return out


def _alphas(total: _Sums, ratio: float, count: int) -> np.ndarray:
    top = float(np.abs(total.centred()[1]).max()) / ratio
    return np.geomspace(top, top * 1e-3, count) if top > 0 else np.array([1e-6])


def _choose(folds: list[_Sums], ratios, count: int):
    """Penalty with the lowest mean held-out error; refitted on all folds."""
    total = sum(folds[1:], folds[0])
    best = None
    for ratio in ratios:
        alphas = _alphas(total, ratio, count)
        errors = np.zeros(len(alphas))
        for i, held in enumerate(folds):
            rest = [f for j, f in enumerate(folds) if j != i]
            train = sum(rest[1:], rest[0])
            errors += [held.sse(b, train.intercept(b)) / held.n / len(folds) for b in _path(train, alphas, ratio)]
        at = int(errors.argmin())
        if best is None or errors[at] < best[0]:
            best = (errors[at], ratio, alphas, at)
    _, ratio, alphas, at = best
    coef = _path(total, alphas[: at + 1], ratio)[-1]
    return total, float(alphas[at]), ratio, coef


def penalised_regression(
    df: DataFrame, features: list[str], y: str, key: str, folds: int = 5, inner: int = 3, n_alphas: int = 100, seed: int = 0
) -> DataFrame:
    """LASSO and elastic net for log(1 + y): chosen penalty, coefficients, in-sample and nested CV R2.

    Two passes: means and deviations for standardising, then one table of cross-products per
    (outer fold, inner fold). Every fit of both cross-validations works on sums of those tables.
    """
    p = len(features)
    rows = df.dropna(subset=[*features, y]).select(
        *[F.col(f).cast("double").alias(f) for f in features], F.log1p(F.col(y).cast("double")).alias("_target"), F.col(key).alias("_key")
    )
    stats = rows.agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]).first()
    z = [((F.col(f) - stats[f]["m"]) / (stats[f]["s"] or 1.0)).alias(f) for f in features]
    cell = (stable_hash(F.lit("outer"), F.lit(seed), "_key") % folds * inner + stable_hash(F.lit("inner"), F.lit(seed), "_key") % inner).cast("int")
    terms = [F.lit(1.0), *[F.col(f) for f in features], F.col("_target"), F.col("_target") * F.col("_target")]
    terms += [F.col(f) * F.col("_target") for f in features] + [F.col(a) * F.col(b) for a in features for b in features]
    sums = rows.select(*z, "_target", cell.alias("cell")).groupBy("cell").agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate(terms)]).collect()
    zero = np.zeros(len(terms))
    cells = {c: _Sums(zero, p) for c in range(folds * inner)}
    cells.update({r["cell"]: _Sums(np.array([float(v) for v in r[1:]]), p) for r in sums})
    add = lambda group: sum(group[1:], group[0])
    outer = [add([cells[f * inner + i] for i in range(inner)]) for f in range(folds)]
    table = []
    for name, ratios in (("lasso", [1.0]), ("elastic_net", [0.1, 0.5, 0.9])):
        total, alpha, ratio, coef = _choose(outer, ratios, n_alphas)
        sst = total.yy - total.y**2 / total.n
        r2 = 1 - total.sse(coef, total.intercept(coef)) / sst
        scores = []
        for f, held in enumerate(outer):
            parts = [add([cells[g * inner + i] for g in range(folds) if g != f]) for i in range(inner)]
            train, _, _, b = _choose(parts, ratios, n_alphas)
            m = train.y / train.n
            base = held.yy - 2 * m * held.y + held.n * m * m
            scores.append(1 - held.sse(b, train.intercept(b)) / base)
        for feature, c in zip(features, coef):
            table.append((name, feature, float(c), alpha, float(ratio), int((np.abs(coef) > 1e-8).sum()), float(r2), float(np.mean(scores))))
    return df.sparkSession.createDataFrame(
        _plain(table), "model string, feature string, coef double, alpha double, l1_ratio double, n_nonzero int, in_sample_r2 double, cv_r2_mean double"
    )
