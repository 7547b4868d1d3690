"""Means and regressions with errors that allow for autocorrelation (Bartlett weights), as matrix aggregates.

A key costs sums of products of its regressors, then sums of products of its scores and of their lags; both are partial sums that Spark adds up.
Only the k x k matrices of a key, k the number of regressors, are inverted in Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import Z95


def bartlett(lags: int) -> list[tuple[int, float]]:
    return [(j, 1 - j / (lags + 1)) for j in range(1, lags + 1)]


def hac_mean(df: DataFrame, by: list[str], order: str, value: str, lags: int) -> DataFrame:
    """For each key: n, mean, hac_se, lower, upper (95 %), effective_n. Null values are left out; with one row only n and the mean are known.

    Rows of a key have different orders.
    """
    key, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(value).isNotNull()).withColumn("__d", F.col(value).cast("double") - F.avg(F.col(value).cast("double")).over(key))
    product = F.col("__d") * F.col("__d")
    for j, c in bartlett(lags):
        product = product + 2 * c * F.col("__d") * F.coalesce(F.lag("__d", j).over(w), F.lit(0.0))
    g = d.withColumn("__p", product).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), (F.sum("__p") / F.count(F.lit(1))).alias("__v"), F.avg(F.col("__d") * F.col("__d")).alias("__g"))
    v = F.greatest("__v", F.lit(1e-12))
    g = g.withColumn("hac_se", F.when(F.col("n") > 1, F.sqrt(v / F.col("n"))))
    g = g.withColumns({"lower": F.col("mean") - Z95 * F.col("hac_se"), "upper": F.col("mean") + Z95 * F.col("hac_se"), "effective_n": F.when(F.col("n") > 1, F.col("n") * F.col("__g") / v)})
    return g.drop("__v", "__g")


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees > x), by the recursion over df."""
    if x <= 0:
        return 1.0
    h = x / 2
    at, p = (2, math.exp(-h)) if df % 2 == 0 else (1, math.erfc(math.sqrt(h)))
    while at < df:
        p += math.exp(at / 2 * math.log(h) - h - math.lgamma(at / 2 + 1))
        at += 2
    return min(1.0, p)


def _symmetric(flat, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    i, j = np.triu_indices(k)
    m[i, j] = m[j, i] = flat
    return m


def _solved(k: int):
    @F.pandas_udf("beta array<double>, inverse array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(xx, xy):
            m = _symmetric(a, k)
            scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
            if np.linalg.matrix_rank(m / np.outer(scale, scale), tol=1e-10) < k:
                rows.append((None, None))
                continue
            inv = np.linalg.inv(m / np.outer(scale, scale)) / np.outer(scale, scale)
            rows.append(((inv @ np.asarray(b)).tolist(), inv.ravel().tolist()))
        return pd.DataFrame(rows, columns=["beta", "inverse"])

    return solve


def _wald(k: int, tested: list[int]):
    @F.pandas_udf("se array<double>, wald double, p_value double")
    def finish(beta: pd.Series, inverse: pd.Series, scores: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for b, inv, s, m in zip(beta, inverse, scores, n):
            if b is None or m <= k:
                rows.append((None, None, None))
                continue
            a = np.asarray(inv).reshape(k, k)
            cov = a @ _symmetric(s, k) @ a * (m / (m - k))
            part, t = cov[np.ix_(tested, tested)], np.asarray(b)[tested]
            d = np.sqrt(np.maximum(np.diag(part), 0))
            ok = (d > 0).all() and np.linalg.matrix_rank(part / np.outer(d, d), tol=1e-10) == len(tested)
            stat = float((t / d) @ np.linalg.inv(part / np.outer(d, d)) @ (t / d)) if ok else None
            rows.append((np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), stat, None if stat is None else chi_square_tail(stat, len(tested))))
        return pd.DataFrame(rows, columns=["se", "wald", "p_value"]).astype({"wald": object, "p_value": object}).where(lambda d: d.notna(), None)

    return finish


def hac_regression(df: DataFrame, by: list[str], order: str, xs: list[str], y: str, lags: int, tested: list[str] | None = None) -> DataFrame:
    """For each key y = intercept + xs: n, beta and se (arrays, the intercept first), and the Wald test that all of `tested` (default: all xs) are zero.

    Rows with a null in y or xs are left out. Keys whose regressors are dependent, or with no more rows than coefficients, have null estimates.
    Rows of a key have different orders.
    """
    k = len(xs) + 1
    x = [f"__x{i}" for i in range(k)]
    ok = F.col(y).isNotNull()
    for c in xs:
        ok = ok & F.col(c).isNotNull()
    d = df.where(ok).select(*by, F.col(order).alias("__at"), F.col(y).cast("double").alias("__y"), F.lit(1.0).alias(x[0]), *[F.col(c).cast("double").alias(n) for c, n in zip(xs, x[1:])])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs]).alias("__xx"), F.array(*[F.sum(F.col(c) * F.col("__y")) for c in x]).alias("__xy"))
    fits = sums.withColumn("__s", _solved(k)(F.col("__xx"), F.col("__xy"))).select(*[F.col(c).alias(f"__by_{c}") for c in by], "n", F.col("__s.beta").alias("beta"), F.col("__s.inverse").alias("__inverse"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    u = F.col("__y")
    for i, c in enumerate(x):
        u = u - F.col("beta")[i] * F.col(c)
    g = d.join(fits, same).withColumn("__u", u).select(*by, "__at", "n", "beta", "__inverse", *[(F.col(c) * F.col("__u")).alias(f"__g{i}") for i, c in enumerate(x)])
    w = Window.partitionBy(*by).orderBy("__at")
    before = {(i, j): F.coalesce(F.lag(f"__g{i}", j).over(w), F.lit(0.0)) for i in range(k) for j, _ in bartlett(lags)}
    g = g.withColumns({f"__l{i}_{j}": c for (i, j), c in before.items()})

    def score(i: int, j: int) -> Column:
        s = F.col(f"__g{i}") * F.col(f"__g{j}")
        for m, c in bartlett(lags):
            s = s + c * (F.col(f"__g{i}") * F.col(f"__l{j}_{m}") + F.col(f"__l{i}_{m}") * F.col(f"__g{j}"))
        return s

    out = g.groupBy(*by).agg(F.first("n").alias("n"), F.first("beta").alias("beta"), F.first("__inverse").alias("__inverse"), F.array(*[F.sum(score(i, j)) for i, j in pairs]).alias("__scores"))
    names = [xs.index(c) + 1 for c in (tested or xs)]
    out = out.withColumn("__f", _wald(k, names)(F.col("beta"), F.col("__inverse"), F.col("__scores"), F.col("n")))
    return out.select(*by, "n", "beta", F.col("__f.se").alias("se"), F.col("__f.wald").alias("wald"), F.col("__f.p_value").alias("p_value"))
