"""Statistical tests and intervals, as columns where a closed form exists and as plain functions for the tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k of n; null for n = 0."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def erf(x: Column) -> Column:
    """Error function to about 1.2e-7 (rational Chebyshev form), so that it stays in generated code."""
    t = 1 / (1 + 0.5 * F.abs(x))
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]  # fixed values
    poly = F.lit(c[-1])
    for v in reversed(c[:-1]):
        poly = poly * t + v
    y = 1 - t * F.exp(-x * x + poly)
    return F.when(x >= 0, y).otherwise(-y)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def student_upper(t: Column, df: int) -> Column:
    """P(T > t) of Student's t with a whole number of degrees of freedom, by its finite sum; exact but for rounding."""
    cos2 = df / (t * t + df)
    if df % 2 == 0:
        term = total = F.lit(1.0)
        for k in range(2, df, 2):
            term = term * cos2 * ((k - 1) / k)
            total = total + term
        inner = t / F.sqrt(t * t + df) * total
    else:
        term = total = F.lit(1.0 if df > 1 else 0.0)
        for k in range(3, df - 1, 2):
            term = term * cos2 * ((k - 1) / k)
            total = total + term
        inner = (F.atan(t / math.sqrt(df)) + t / F.sqrt(t * t + df) * F.sqrt(cos2) * total) * (2 / math.pi)
    return (1 - inner) / 2


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
        c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def student_tail(t: float, df: float) -> float:
    """P(T > t)."""
    x = df / (df + t * t)
    tail = incomplete_beta(df / 2, 0.5, x) / 2
    return tail if t > 0 else 1 - tail


def chi_square_tail_1(x: float) -> float:
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def binomial_lower(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    return 1.0 if k >= n else incomplete_beta(n - k, k + 1, 1 - p)


def mcnemar(b: int, c: int, two_sided: bool = True) -> float:
    """Exact test of discordant counts; one-sided: that b is not larger than c by chance."""
    if b + c == 0:
        return 1.0
    if two_sided:
        return min(1.0, 2 * binomial_lower(min(b, c), b + c, 0.5))
    return 1 - binomial_lower(b - 1, b + c, 0.5) if b else 1.0


def diebold_mariano(loss_a, loss_b, lags: int | None = None, horizon: int = 1) -> dict:
    """Mean loss difference, its HAC deviation (Bartlett weights) and the two-sided normal p-value. lags default: horizon - 1."""
    d = np.asarray(loss_a, float) - np.asarray(loss_b, float)
    d = d[np.isfinite(d)]
    n, lags = len(d), horizon - 1 if lags is None else lags
    if n < 2:
        return {"n": n, "mean": None, "stat": None, "p": None}
    x = d - d.mean()
    var = (x @ x) / n + 2 * sum((1 - k / (lags + 1)) * (x[k:] @ x[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    if var <= 0:
        return {"n": n, "mean": float(d.mean()), "stat": None, "p": None}
    stat = d.mean() / math.sqrt(var / n)
    return {"n": n, "mean": float(d.mean()), "stat": stat, "p": math.erfc(abs(stat) / math.sqrt(2))}


def diebold_mariano_by(df: DataFrame, by: list[str], order: str, a: str, b: str, lags: int) -> DataFrame:
    """The same per group in window sums: lag products need no grouped Python."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__d", F.col(a) - F.col(b)).where("__d is not null")
    d = d.withColumn("__x", F.col("__d") - F.avg("__d").over(Window.partitionBy(*by)))
    lagged = [F.lag("__x", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)]
    d = d.select("*", *lagged)
    var = F.sum(F.col("__x") * F.col("__x"))
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("__x") * F.col(f"__l{k}")), F.lit(0.0))
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mean_diff"), (var / F.count(F.lit(1))).alias("__v"))
    stat = F.col("mean_diff") / F.sqrt(F.col("__v") / F.col("n"))
    return out.withColumn("dm_stat", F.when((F.col("n") > 1) & (F.col("__v") > 0), stat)).drop("__v")


def wilcoxon(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """Signed ranks (zeros dropped, average ties): n, W+, W- and the normal statistic with tie correction left out."""
    d = df.where(F.col(difference) != 0).withColumn("__a", F.abs(difference))
    rank = F.rank().over(Window.partitionBy(*by).orderBy("__a")) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "__a")) - 1) / 2
    d = d.withColumn("__r", rank)
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(difference) < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n")
    return out.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values, Benjamini-Hochberg and Bonferroni, and whether each is rejected at alpha.

    A null p-value takes no rank and is not rejected; it still counts as one of the tests made.
    """
    w, m = Window.partitionBy(*by), F.count(F.lit(1)).over(Window.partitionBy(*by))
    d = df.withColumn("__m", m).withColumn("__i", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last())))
    raw = F.col(p) * F.col("__m") / F.col("__i")
    d = d.withColumn("p_bh", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(raw).over(w.orderBy("__i").rowsBetween(0, Window.unboundedFollowing)))))
    d = d.withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("__m"))))
    return d.withColumn("reject_bh", F.coalesce(F.col("p_bh") <= alpha, F.lit(False))).drop("__m", "__i")


def _xlogy(k: Column, p: Column) -> Column:
    return F.when(k > 0, k * F.ln(F.when(p > 0, p))).otherwise(0.0)


def kupiec(n: Column, x: Column, rate: float) -> Column:
    """Likelihood ratio of x misses in n against the nominal rate (one degree of freedom)."""
    p = x / F.when(n > 0, n)
    return -2 * (_xlogy(n - x, F.lit(1 - rate)) + _xlogy(x, F.lit(rate)) - _xlogy(n - x, 1 - p) - _xlogy(x, p))


def christoffersen(df: DataFrame, by: list[str], order: str, miss: str) -> DataFrame:
    """Transition counts of misses and the likelihood ratio of independence."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__p", F.lag(miss).over(w)).where("__p is not null")
    n = {f"n{a}{b}": F.sum(((F.col("__p") == a) & (F.col(miss) == b)).cast("int")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)}
    out = d.groupBy(*by).agg(*n.values())
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    p0, p1 = n01 / F.when(n00 + n01 > 0, n00 + n01), n11 / F.when(n10 + n11 > 0, n10 + n11)
    p = (n01 + n11) / (n00 + n01 + n10 + n11)
    lr = -2 * (_xlogy(n00 + n10, 1 - p) + _xlogy(n01 + n11, p) - _xlogy(n00, 1 - p0) - _xlogy(n01, p0) - _xlogy(n10, 1 - p1) - _xlogy(n11, p1))
    return out.withColumn("lr_independence", F.coalesce(lr, F.lit(0.0)))


def permutation_p(a, b, draws: int = 2000, seed: int = 7) -> float:
    """Two-sided p-value of the difference of means under shuffled labels."""
    rng, x, n = np.random.default_rng(seed), np.concatenate((a, b)).astype(float), len(a)
    seen = abs(np.mean(a) - np.mean(b))
    hits = 0
    for _ in range(draws):
        rng.shuffle(x)
        hits += abs(x[:n].mean() - x[n:].mean()) >= seen - 1e-12
    return (hits + 1) / (draws + 1)


def sample_size(effect: float, deviation: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Observations for a two-sided mean test to find `effect`."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return math.ceil((z * deviation / effect) ** 2)


def power_of(effect: float, deviation: float, n: int, alpha: float = 0.05) -> float:
    z = effect / deviation * math.sqrt(n) - normal_quantile(1 - alpha / 2)
    return 0.5 * math.erfc(-z / math.sqrt(2))


def mixture_boundary(variance: float, alpha: float = 0.05, rho: float = 1.0) -> float:
    """Normal-mixture bound of a running sum with the given accumulated variance, valid at all times at once."""
    return math.sqrt((variance + rho) * (2 * math.log(1 / alpha) + math.log((variance + rho) / rho)))


def confidence_sequence(df: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.05, rho: float = 1.0) -> DataFrame:
    """Mean of all rows so far with bounds that hold at every row at once (normal mixture over the running variance)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n, mean = F.count(value).over(w), F.avg(value).over(w)
    v = n * F.coalesce(F.var_pop(value).over(w), F.lit(0.0))
    bound = F.sqrt((v + rho) * (2 * math.log(1 / alpha) + F.ln((v + rho) / rho))) / n
    return df.withColumns({"cs_n": n, "cs_mean": mean, "cs_lower": mean - bound, "cs_upper": mean + bound})


def coverage_e_value(k: Column, n: Column, target: float, grid: int = 99) -> Column:
    """Mixture likelihood ratio of k hits in n over rates below the target, in log space."""
    rates = F.transform(F.sequence(F.lit(1), F.lit(grid)), lambda i: i * (target / (grid + 1)))
    logs = F.transform(rates, lambda r: k * F.ln(r / target) + (n - k) * F.ln((1 - r) / (1 - target)))
    top = F.array_max(logs)
    return F.exp(top) * F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top)) / grid
