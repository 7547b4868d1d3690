"""Walk-forward calibration, forecasts and conformal bands.

Each row uses only what had matured before it. Expanding fits run on window sums (sufficient statistics), so a fold costs a row
and no self-join. Rows of a key are ordered by decision day; `label_day` says when a row's outcome became known.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import normal_cdf


def matured(by: list[str], decision: str, extra: list[str] | None = None) -> Window:
    """All strictly earlier rows; with step-by-step labels these are the matured ones."""
    return Window.partitionBy(*by).orderBy(decision, *(extra or [])).rowsBetween(Window.unboundedPreceding, -1)


def matured_sums(df: DataFrame, by: list[str], decision: str, label_day: str, sums: dict[str, Column], strict: bool = True, latest: dict[str, Column] | None = None) -> DataFrame:
    """For each row the sums over all rows whose label_day is before (not strict: not after) its decision day.

    latest: values of the one of these rows with the latest decision.

    Labels and decisions are two events in one timeline; a running sum over it needs one sort for each key, no pairing.
    """
    names, latest = df.columns, latest or {}
    newest = {k: F.struct(F.col(decision).alias("at"), c.cast("double").alias("v")) for k, c in latest.items()}
    kinds = {k: df.select(c.alias("c")).schema["c"].dataType for k, c in newest.items()}
    ev = df.select(*by, F.col(decision).alias("__at"), F.lit(1 if not strict else 0).alias("__turn"), F.struct(*names).alias("__row"), *[F.lit(None).cast("double").alias(f"__{k}") for k in sums], *[F.lit(None).cast(kinds[k]).alias(f"__{k}") for k in latest])
    out = df.where(F.col(label_day).isNotNull()).select(*by, F.col(label_day).alias("__at"), F.lit(0 if not strict else 1).alias("__turn"), F.lit(None).cast(ev.schema["__row"].dataType).alias("__row"), *[c.cast("double").alias(f"__{k}") for k, c in sums.items()], *[c.alias(f"__{k}") for k, c in newest.items()])
    w = Window.partitionBy(*by).orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    d = ev.unionByName(out).select("*", *[F.coalesce(F.sum(f"__{k}").over(w), F.lit(0.0)).alias(k) for k in sums], *[F.max(f"__{k}").over(w)["v"].alias(k) for k in latest])
    return d.where("__row is not null").select("__row.*", *sums, *latest)


def slope_forecast(df: DataFrame, by: list[str], decision: str, label_day: str, x: str, y: str, least: int = 30) -> DataFrame:
    """y = slope x through the origin on matured rows: slope, forecast, residual deviation and P(y > 0)."""
    xx, xy, yy = F.col(x) * F.col(x), F.col(x) * F.col(y), F.col(y) * F.col(y)
    d = matured_sums(df, by, decision, label_day, {"__xx": xx, "__xy": xy, "__yy": yy, "__n": F.when(xy.isNotNull(), 1)}, strict=False)
    slope = F.when((F.col("__n") >= least) & (F.col("__xx") > 0), F.col("__xy") / F.when(F.col("__xx") > 0, F.col("__xx")))
    d = d.withColumn("slope", slope).withColumn("forecast", F.col("slope") * F.col(x))
    rss = F.col("__yy") - 2 * F.col("slope") * F.col("__xy") + F.col("slope") * F.col("slope") * F.col("__xx")
    d = d.withColumn("resid_sd", F.sqrt(F.try_divide(F.greatest(rss, F.lit(0.0)), F.col("__n"))))
    return d.withColumn("p_up", normal_cdf(F.try_divide(F.col("forecast"), F.col("resid_sd")))).drop("__xx", "__xy", "__yy", "__n")


def rolling_slope(df: DataFrame, by: list[str], decision: str, x: str, y: str, n: int = 60, least: int = 30) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(decision).rowsBetween(-n, -1)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx = F.sum(F.when(both, F.col(x) * F.col(x))).over(w)
    return df.withColumn("slope", F.when((F.sum(both.cast("int")).over(w) >= least) & (xx > 0), F.sum(F.col(x) * F.col(y)).over(w) / F.when(xx > 0, xx)))


def recency_fit(df: DataFrame, by: list[str], order: str, x: str, y: str, halflife: float = 10.0, least: int = 30) -> DataFrame:
    """Weighted least-squares line over all strictly earlier rows, weights 0.5^(age in rows / halflife).

    Weights are kept relative to blocks of 50 half-lives, so that no power under- or overflows on long series; older blocks than the one
    before weigh less than 2^-50.
    """
    size = max(1, math.ceil(50 * halflife))
    w0 = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__i", F.row_number().over(w0)).withColumn("__blk", F.floor(F.col("__i") / size))
    wt = F.pow(F.lit(2.0), (F.col("__i") - (F.col("__blk") + 1) * size) / halflife)
    d = d.withColumn("__w", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), wt))
    past = Window.partitionBy(*by, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("__blk").rangeBetween(-1, -1)  # the block before
    names = {"w": F.col("__w"), "x": F.col("__w") * F.col(x), "y": F.col("__w") * F.col(y), "xx": F.col("__w") * F.col(x) * F.col(x), "xy": F.col("__w") * F.col(x) * F.col(y)}
    shift = F.pow(F.lit(2.0), F.lit(-size / halflife))
    s = {k: F.coalesce(F.sum(v).over(past), F.lit(0.0)) + shift * F.coalesce(F.sum(v).over(before), F.lit(0.0)) for k, v in names.items()}
    d = d.withColumns({f"__s{k}": v for k, v in s.items()})
    det = F.col("__sw") * F.col("__sxx") - F.col("__sx") * F.col("__sx")
    n = F.count("__w").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    good = (n >= least) & (det > 1e-9 * F.col("__sw") * F.col("__sw"))
    slope = F.when(good, (F.col("__sw") * F.col("__sxy") - F.col("__sx") * F.col("__sy")) / F.when(good, det))
    d = d.withColumn("slope", slope).withColumn("intercept", F.when(F.col("slope").isNotNull(), (F.col("__sy") - F.col("slope") * F.col("__sx")) / F.col("__sw")))
    return d.withColumn("fitted", F.col("slope") * F.col(x) + F.col("intercept")).drop("__i", "__blk", "__w", *[f"__s{k}" for k in names])


def huber_line(x: np.ndarray, y: np.ndarray, w: np.ndarray, epsilon: float = 1.35, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept of a weighted Huber fit by reweighting; weighted least squares where it does not settle."""

    def solve(v):
        mx, my = (v * x).sum() / v.sum(), (v * y).sum() / v.sum()
        sxx = (v * (x - mx) ** 2).sum()
        a = (v * (x - mx) * (y - my)).sum() / sxx if sxx > 0 else 0.0
        return a, my - a * mx

    a, b = first = solve(w)
    for _ in range(steps):
        r = y - a * x - b
        s = np.median(np.abs(r)) / 0.6744897501960817
        if s <= 0:
            return a, b
        new = solve(w * np.minimum(1, epsilon * s / np.maximum(np.abs(r), 1e-300)))
        if not np.isfinite(new).all():
            return first
        if abs(new[0] - a) + abs(new[1] - b) < 1e-10 * (1 + abs(a) + abs(b)):
            return new
        a, b = new
    return a, b


def calibration(df: DataFrame, by: list[str], order: str, x: str, y: str, halflife: float = 10.0, least: int = 30) -> DataFrame:
    """Robust recency-weighted line for each key with weighted |residual| bands at 68, 80 and 90 %; null below `least` pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(order).dropna(subset=[x, y])
        keys, n = [pdf[c].iloc[0] for c in by], len(d)
        if n < least:
            return pd.DataFrame([[*keys, n, None, None, None, None, None, None]], columns=names)
        xs, ys = d[x].to_numpy(float), d[y].to_numpy(float)
        w = 0.5 ** ((n - 1 - np.arange(n)) / halflife)
        a, b = huber_line(xs, ys, w)
        r = np.abs(ys - a * xs - b)
        turn = np.argsort(r, kind="stable")
        share = np.cumsum(w[turn]) / w.sum()
        band = [float(r[turn][min(n - 1, int(np.searchsorted(share, q - 1e-12)))]) for q in (0.68, 0.8, 0.9)]
        ss = ((ys - ys.mean()) ** 2).sum()
        return pd.DataFrame([[*keys, n, a, b, 1 - ((ys - a * xs - b) ** 2).sum() / ss if ss > 0 else None, *band]], columns=names)

    names = [*by, "n", "slope", "intercept", "r2", "band68", "band80", "band90"]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(run, f"{kinds}, n long, slope double, intercept double, r2 double, band68 double, band80 double, band90 double")


def conformal_band(df: DataFrame, by: list[str], order: str, forecast: str, actual: str, level: float = 0.8, window: int = 60, least: int = 20) -> DataFrame:
    """Half width: the level's linear quantile of the last `window` absolute errors before each row; null with fewer than `least`."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-window, -1)
    err = F.abs(F.col(actual) - F.col(forecast))
    d = df.withColumn("__e", err)
    q = F.when(F.count("__e").over(w) >= least, F.percentile("__e", F.lit(level)).over(w))
    return d.withColumn("half_width", q).withColumn("lower", F.col(forecast) - F.col("half_width")).withColumn("upper", F.col(forecast) + F.col("half_width")).drop("__e")


def cqr(df: DataFrame, by: list[str], decision: str, label_day: str, lower: str, upper: str, actual: str, level: float = 0.8, window: int = 250, least: int = 20) -> DataFrame:
    """Conformalised bands: the order statistic ceil((n+1) level) of matured scores widens each band."""
    names = df.columns
    score = F.greatest(F.col(lower) - F.col(actual), F.col(actual) - F.col(upper))
    ev = df.select(*by, F.col(decision).alias("__at"), F.lit(0).alias("__turn"), F.struct(*names).alias("__row"), F.lit(None).cast("double").alias("__s"))
    seen = df.where(score.isNotNull() & F.col(label_day).isNotNull()).select(*by, F.col(label_day).alias("__at"), F.lit(1).alias("__turn"), F.lit(None).cast(ev.schema["__row"].dataType).alias("__row"), score.cast("double").alias("__s"))
    w = Window.partitionBy(*by).orderBy("__at", "__turn")
    u = ev.unionByName(seen).withColumn("__k", F.count("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    recent = Window.partitionBy(*by).orderBy("__k").rangeBetween(-(window - 1), 0)
    u = u.withColumn("__past", F.collect_list("__s").over(recent)).where("__row is not null")
    n = F.size("__past")
    k = F.least(F.ceil((n + 1) * level), n).cast("int")
    u = u.withColumn("adjust", F.when(n >= least, F.try_element_at(F.array_sort("__past"), k)))
    return u.select("__row.*", "adjust").withColumn("cqr_lower", F.col(lower) - F.col("adjust")).withColumn("cqr_upper", F.col(upper) + F.col("adjust"))


def adaptive_level(errors: np.ndarray, target: float = 0.8, gamma: float = 0.02, window: int = 60, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive conformal inference: after each miss the level rises by gamma (1 - target), after each hit it falls by gamma target... so
    that long-run coverage holds. Returns half widths and levels; NaN before `least` errors."""
    level, half, levels = target, np.full(len(errors), np.nan), np.full(len(errors), np.nan)
    for i, e in enumerate(errors):
        past = errors[max(0, i - window) : i]
        past = past[np.isfinite(past)]
        levels[i] = level
        if len(past) >= least:
            half[i] = np.quantile(past, min(max(level, 0.0), 1.0))
            if np.isfinite(e):
                level = level + gamma * (target - (1.0 if e <= half[i] else 0.0))
    return half, levels


def adaptive_conformal(df: DataFrame, by: list[str], order: str, forecast: str, actual: str, **options) -> DataFrame:
    """Sequential by nature: one task a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(order)
        half, levels = adaptive_level((d[actual] - d[forecast]).abs().to_numpy(float), **options)
        return d.assign(aci_half=half, aci_level=levels)

    return df.groupBy(*by).applyInPandas(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), "aci_half double", "aci_level double"]))


def path_ranges(df: DataFrame, by: list[str], order: str, value: str, k: int, window: int = 500, low: float = 0.1, high: float = 0.9, least: int = 30) -> DataFrame:
    """Quantiles of the least and most log move within k steps, over the trailing rows whose path is complete."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = w.rowsBetween(1, k)
    whole = F.count(value).over(ahead) == k
    d = df.withColumn("__lo", F.when(whole, F.ln(F.min(value).over(ahead) / F.col(value)))).withColumn("__hi", F.when(whole, F.ln(F.max(value).over(ahead) / F.col(value))))
    past = w.rowsBetween(-(window + k), -k)  # complete before the row
    enough = F.count("__lo").over(past) >= least
    return d.withColumn("range_low", F.when(enough, F.percentile("__lo", F.lit(low)).over(past))).withColumn("range_high", F.when(enough, F.percentile("__hi", F.lit(high)).over(past))).drop("__lo", "__hi")


def volatility_band(df: DataFrame, by: list[str], order: str, value: str, n: int, days: float, z: float = 1.2815515655446004, floor: float = 0.0) -> DataFrame:
    """Realised-volatility half width with a floor, and a regime by its own trailing median."""
    w0 = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__r", F.ln(F.col(value) / F.lag(value).over(w0)))
    vol = F.stddev_samp("__r").over(w0.rowsBetween(-(n - 1), 0))
    d = d.withColumn("vol", vol).withColumn("half_width", F.greatest(F.lit(floor), z * F.col("vol") * math.sqrt(days) * F.col(value)))
    mid = F.percentile("vol", F.lit(0.5)).over(w0.rowsBetween(-250, -1))
    return d.withColumn("regime", F.when(F.col("vol").isNull() | mid.isNull(), None).when(F.col("vol") > 1.5 * mid, "high").when(F.col("vol") < 0.67 * mid, "low").otherwise("normal")).drop("__r")


def labels(df: DataFrame, move: str, dead: float = 50.0) -> DataFrame:
    """Ternary with a dead band, strict binary, and binary outside the band (null inside)."""
    m = F.col(move)
    return df.withColumn("label3", F.when(m > dead, 1).when(m < -dead, -1).when(m.isNotNull(), 0)).withColumn("label2", F.when(m.isNotNull(), (m > 0).cast("int"))).withColumn("label_far", F.when(F.abs(m) > dead, (m > 0).cast("int")))


def mean_imputed(df: DataFrame, by: list[str], order: str, c: str) -> DataFrame:
    """Nulls take the mean of strictly earlier rows only."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(f"{c}_imputed", F.coalesce(c, F.avg(c).over(w)))


def choose_source(candidates: list[tuple[str, Column, Column]], reference: Column, most_off: float = 0.12) -> Column:
    """The first candidate (name, value, usable) in order of trust that lies within most_off of the reference; a null reference lets all pass."""
    picks = []
    for name, value, usable in candidates:
        near = F.coalesce(F.abs(value / reference - 1) <= most_off, F.lit(True))
        picks.append(F.when(usable & value.isNotNull() & near, F.struct(F.lit(name).alias("source"), value.cast("double").alias("value"))))
    return F.coalesce(*picks)


def fix_mode(slot: Column, after_close: Column, model_ready: Column) -> Column:
    """Which next-fix forecast is shown: hold in the morning slot, the model after the other market's close, else hold."""
    return F.when(slot == "am", "hold").when((slot == "pm") & after_close & model_ready, "model").otherwise("hold")
