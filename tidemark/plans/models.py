"""Per-series models: volatility, filtering, simulation and classifiers. One task fits one key; a key's series is short by nature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.stats import normal_quantile


def simplex(f, start, steps: int = 400, size: float = 0.3):
    """Downhill simplex search."""
    n = len(start)
    pts = [np.array(start, float)] + [np.array(start, float) + size * np.eye(n)[i] for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if vals[-1] - vals[0] < 1e-10 * (1 + abs(vals[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        for scale in (1.0, 2.0, 0.5, -0.5):
            p = mid + scale * (mid - pts[-1])
            v = f(p)
            if scale == 1.0:
                first = (p, v)
                if vals[0] <= v < vals[-2]:
                    break
            elif scale == 2.0:
                if first[1] < vals[0]:
                    p, v = (p, v) if v < first[1] else first
                    break
            elif v < min(first[1], vals[-1]):
                break
        else:
            pts = [pts[0]] + [pts[0] + 0.5 * (q - pts[0]) for q in pts[1:]]
            vals = [vals[0]] + [f(q) for q in pts[1:]]
            continue
        pts[-1], vals[-1] = p, v
    return pts[int(np.argmin(vals))]


def garch_path(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """Conditional variances, the next one included."""
    v = np.empty(len(r) + 1)
    v[0] = r.var() if len(r) else omega
    for i, x in enumerate(r):
        v[i + 1] = omega + alpha * x * x + beta * v[i]
    return v


def fit_garch(r: np.ndarray, student: bool = False) -> dict:
    """GARCH(1,1) by maximum likelihood, normal or Student-t errors; parameters kept positive and alpha + beta below 1."""
    base = max(r.var(), 1e-12)

    def unpack(p):
        e = np.exp(np.clip(p[:3], -30, 30))
        s = 1 + e[1] + e[2]
        return base * min(e[0], 10), e[1] / s, e[2] / s, 2.1 + math.exp(min(p[3], 6)) if student else None

    def loss(p):
        o, a, b, nu = unpack(p)
        v = np.maximum(garch_path(r, o, a, b)[:-1], 1e-18)
        z = r * r / v
        if student:
            c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
            return float((0.5 * np.log(v) + (nu + 1) / 2 * np.log1p(z / (nu - 2)) - c).sum())
        return float(0.5 * (np.log(v) + z).sum())

    p = simplex(loss, [math.log(0.05), math.log(1.0), math.log(8.0), *([math.log(6.0)] if student else [])])
    o, a, b, nu = unpack(p)
    return {"omega": o, "alpha": a, "beta": b, "nu": nu, "next_var": float(garch_path(r, o, a, b)[-1])}


def garch_forecast(df: DataFrame, by: list[str], order: str, ret: str, days: int, level: float = 0.8, least: int = 60, student: bool = False) -> DataFrame:
    """Parameters, the variance of the next `days` days and its symmetric normal bound, for each key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(order)[ret].dropna().to_numpy(float)
        keys = [pdf[c].iloc[0] for c in by]
        if len(r) < least:
            return pd.DataFrame([[*keys, len(r), *[None] * 5]], columns=names)
        m = fit_garch(r - r.mean(), student)
        keep = m["alpha"] + m["beta"]
        flat = m["omega"] / max(1e-12, 1 - keep)
        var = days * flat + (m["next_var"] - flat) * (1 - keep**days) / max(1e-12, 1 - keep)
        return pd.DataFrame([[*keys, len(r), m["omega"], m["alpha"], m["beta"], var, normal_quantile((1 + level) / 2) * math.sqrt(var)]], columns=names)

    names = [*by, "n", "omega", "alpha", "beta", "variance", "bound"]
    return df.groupBy(*by).applyInPandas(run, kinds(df, by) + ", n long, omega double, alpha double, beta double, variance double, bound double")


def kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def har_forecast(rv: np.ndarray, days: int) -> float | None:
    """Heterogeneous autoregression on daily, weekly and monthly means of realised variance, iterated `days` ahead; the sum."""
    if len(rv) < 60:
        return None
    roll = lambda x, k, i: x[max(0, i - k + 1) : i + 1].mean()
    rows = [[1.0, rv[i], roll(rv, 5, i), roll(rv, 22, i)] for i in range(21, len(rv) - 1)]
    coef, *_ = np.linalg.lstsq(np.array(rows), rv[22:], rcond=None)
    x, total = list(rv), 0.0
    for _ in range(days):
        a = np.array(x)
        nxt = max(0.0, float(coef @ [1.0, a[-1], a[-5:].mean(), a[-22:].mean()]))
        x.append(nxt)
        total += nxt
    return total


def har(df: DataFrame, by: list[str], order: str, ret: str, days: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(order)[ret].dropna().to_numpy(float)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), len(r), har_forecast(r * r, days)]], columns=[*by, "n", "variance"])

    return df.groupBy(*by).applyInPandas(run, kinds(df, by) + ", n long, variance double")


def kalman_level(obs: np.ndarray, ages: np.ndarray, q: float, r: np.ndarray, r_age: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A random-walk level seen through sources with constant offsets; old readings weigh less. NaN: no reading.

    obs and ages are (time, source); the first source is the anchor with offset 0. Returns level and variance after each step.
    """
    t, s = obs.shape
    first = obs[np.isfinite(obs)]
    x = np.concatenate(([first[0] if len(first) else 0.0], np.zeros(s - 1)))
    p = np.diag(np.concatenate(([1e6], np.full(s - 1, 1e4))))
    level, var = np.empty(t), np.empty(t)
    for i in range(t):
        p[0, 0] += q
        for j in range(s):
            if np.isfinite(obs[i, j]):
                h = np.zeros(s)
                h[0] = 1.0
                if j:
                    h[j] = 1.0
                k = p @ h / (h @ p @ h + r[j] * (1 + r_age * ages[i, j]))
                x = x + k * (obs[i, j] - h @ x)
                p = p - np.outer(k, h @ p)
        level[i], var[i] = x[0], p[0, 0]
    return level, var


def kalman(df: DataFrame, by: list[str], order: str, sources: list[str], q: float, r: list[float]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(order)
        obs = d[sources].to_numpy(float)
        level, var = kalman_level(obs, np.zeros_like(obs), q, np.array(r))
        return d[[*by, order]].assign(level=level, level_var=var)

    return df.groupBy(*by).applyInPandas(run, kinds(df, [*by, order]) + ", level double, level_var double")


def filtered_simulation(r: np.ndarray, days: int, lam: float = 0.94, draws: int = 2000, seed: int = 11) -> tuple[float, float] | None:
    """Filtered historical simulation: returns standardised by their moving deviation, drawn anew; 10 and 90 % points of the sum."""
    if len(r) < 60:
        return None
    v = np.empty(len(r) + 1)
    v[0] = r.var()
    for i, x in enumerate(r):
        v[i + 1] = lam * v[i] + (1 - lam) * x * x
    z = r / np.sqrt(np.maximum(v[:-1], 1e-18))
    rng = np.random.default_rng(seed)
    now, total = np.full(draws, v[-1]), np.zeros(draws)
    for _ in range(days):
        x = np.sqrt(now) * rng.choice(z, draws)
        total += x
        now = lam * now + (1 - lam) * x * x
    return float(np.quantile(total, 0.1)), float(np.quantile(total, 0.9))


def best_lambda(r: np.ndarray, grid=(0.9, 0.92, 0.94, 0.96, 0.98)) -> float:
    """The decay with the least QLIKE loss."""

    def loss(lam):
        v, out = r[:20].var() or 1e-12, 0.0
        for x in r:
            out += math.log(max(v, 1e-18)) + x * x / max(v, 1e-18)
            v = lam * v + (1 - lam) * x * x
        return out

    return min(grid, key=loss)


def simulated_ranges(df: DataFrame, by: list[str], order: str, ret: str, days: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(order)[ret].dropna().to_numpy(float)
        lam = best_lambda(r) if len(r) >= 60 else None
        got = filtered_simulation(r, days, lam) if lam else None
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), len(r), lam, *(got or (None, None))]], columns=[*by, "n", "decay", "low", "high"])

    return df.groupBy(*by).applyInPandas(run, kinds(df, by) + ", n long, decay double, low double, high double")


def quantile_line(x: np.ndarray, y: np.ndarray, q: float, steps: int = 300) -> np.ndarray:
    """Linear quantile regression by reweighted least squares; x has its own constant column."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(steps):
        r = y - x @ beta
        w = np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), 1e-6)
        new = np.linalg.solve((x * w[:, None]).T @ x + 1e-9 * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
        if np.abs(new - beta).max() < 1e-9:
            break
        beta = new
    return beta


def turnbull(left: np.ndarray, right: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Nonparametric distribution of an event known only to lie in (left, right]: interval ends and their masses, by EM."""
    ends = np.unique(right)
    a = (ends[None, :] > left[:, None]) & (ends[None, :] <= right[:, None])
    p = np.full(len(ends), 1 / max(1, len(ends)))
    for _ in range(steps):
        w = a * p
        new = (w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
        if np.abs(new - p).max() < 1e-10:
            break
        p = new
    return ends, p


def classifier(kind: str, features: list[str], label: str):
    """A Spark ML pipeline: logistic or boosted trees over the feature columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    fit = LogisticRegression(labelCol=label, regParam=0.01) if kind == "logistic" else GBTClassifier(labelCol=label, maxIter=20, maxDepth=3, seed=3)
    return Pipeline(stages=[assemble, fit])


def ridge_cv(x: np.ndarray, y: np.ndarray, grid=(0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 5) -> tuple[float, np.ndarray]:
    """Ridge regression with the penalty chosen on ordered folds."""

    def solve(a, b, k):
        return np.linalg.solve(a.T @ a + k * np.eye(a.shape[1]), a.T @ b)

    cut = np.array_split(np.arange(len(y)), folds)
    err = [sum(((y[c] - x[c] @ solve(np.delete(x, c, 0), np.delete(y, c), k)) ** 2).sum() for c in cut) for k in grid]
    best = grid[int(np.argmin(err))]
    return best, solve(x, y, best)
