"""Window operators: time ranges, gaps and islands, trailing statistics, forward paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = {"hours": 3_600_000_000, "days": 86_400_000_000}


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def range_open(by: list[str], ts: str, days: float) -> Window:
    """Rows in (t - days, t]: open on the left."""
    return Window.partitionBy(*by).orderBy(micros(ts)).rangeBetween(-int(days * MICROS["days"]) + 1, 0)


def range_before(by: list[str], ts: str, days: float) -> Window:
    """Rows in [t - days, t): strictly before."""
    return Window.partitionBy(*by).orderBy(micros(ts)).rangeBetween(-int(days * MICROS["days"]), -1)


def rows_before(by: list[str], order: list, n: int) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)


def rolling(df: DataFrame, by: list[str], ts: str, value: str, days: float, least: int = 1) -> DataFrame:
    """Mean, sample deviation (0 where undefined), least, most and count over the open time range."""
    w = range_open(by, ts, days)
    n = F.count(value).over(w)
    at = {"mean": F.avg(value).over(w), "std": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), "min": F.min(value).over(w), "max": F.max(value).over(w)}
    return df.withColumns({f"r_{k}": F.when(n >= least, v) for k, v in at.items()} | {"r_n": n})


def islands(df: DataFrame, by: list[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Number of breaks up to each row; `breaks` may use lag(...) over the ordered window."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__b", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def gap_segments(df: DataFrame, by: list[str], day: str, most_gap: int) -> DataFrame:
    """Segments of consecutive rows whose steps are at most most_gap days."""
    w = Window.partitionBy(*by).orderBy(day)
    return islands(df, by, day, F.datediff(day, F.lag(day).over(w)) > most_gap, "segment")


def rows_since(df: DataFrame, by: list[str], order: str, event: Column, name: str) -> DataFrame:
    """Rows since the last event: 0 on it, counting from 1 before the first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = F.coalesce(event, F.lit(False)).cast("int")
    d = df.withColumn("__e", e).withColumn("__i", F.sum("__e").over(w))
    inside = Window.partitionBy(*by, "__i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum(1 - F.col("__e")).over(inside)).drop("__e", "__i")


def run_lengths(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: value, first and last order, length."""
    w = Window.partitionBy(*by).orderBy(order)
    d = islands(df, by, order, ~F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), "__run")
    return d.groupBy(*by, "__run").agg(F.first(value).alias(value), F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("__run")


def drop_repeats(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__p", F.lag(value).over(w)).withColumn("__f", F.row_number().over(w)).where((F.col("__f") == 1) | ~F.col(value).eqNullSafe(F.col("__p"))).drop("__p", "__f")


def forward_fill(df: DataFrame, by: list[str], day: str, columns: list[str]) -> DataFrame:
    """Last known value and the day it dates from."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}_filled": F.last(c, True).over(w) for c in columns} | {f"{c}_asof": F.last(F.when(F.col(c).isNotNull(), F.col(day)), True).over(w) for c in columns})


def quantile_over(value: str | Column, q: float, w: Window) -> Column:
    """Linear quantile over a frame."""
    return F.percentile(value, F.lit(q)).over(w)


def trailing_rank(df: DataFrame, by: list[str], order: str, value: str, n: int, name: str = "pct_rank") -> DataFrame:
    """Share of the n strictly earlier values that are not above the row's; null without any."""
    w = rows_before(by, [order], n)
    past = F.collect_list(value).over(w)
    below = F.size(F.filter(past, lambda x: x <= F.col(value)))
    return df.withColumn(name, F.when(F.size(past) > 0, below / F.size(past)))


def robust_z(df: DataFrame, by: list[str], order: str, value: str, n: int, least: int, name: str = "robust_z") -> DataFrame:
    """(value - median) / (1.4826 MAD) over the n rows before; null with fewer than `least` or no spread."""
    w = rows_before(by, [order], n)
    d = df.withColumn("__p", F.collect_list(value).over(w)).withColumn("__m", quantile_over(value, 0.5, w))
    dev = F.array_sort(F.transform("__p", lambda x: F.abs(x - F.col("__m"))))
    k = F.size("__p")
    mad = F.when(k > 0, (F.try_element_at(dev, F.greatest(F.lit(1), ((k + 1) / 2).cast("int"))) + F.try_element_at(dev, F.greatest(F.lit(1), ((k + 2) / 2).cast("int")))) / 2)
    return d.withColumn("__d", mad).withColumn(name, F.when((k >= least) & (F.col("__d") > 0), (F.col(value) - F.col("__m")) / (1.4826 * F.col("__d")))).drop("__p", "__m", "__d")


def ewma(df: DataFrame, by: list[str], order: str, value: str, halflife: float, name: str) -> DataFrame:
    """Half-life weighted mean of the values strictly before, ages counted in values that are there.

    Sums of a block of 50 half-lives and of the block before it are added (older values weigh below 2^-50), so a row costs two window sums.
    """
    size = max(1, math.ceil(50 * halflife))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__i", F.count(value).over(w)).withColumn("__blk", F.floor(F.col("__i") / size))
    d = d.withColumn("__w", F.when(F.col(value).isNotNull(), F.pow(F.lit(2.0), (F.col("__i") - (F.col("__blk") + 1) * size) / halflife)))
    past = Window.partitionBy(*by, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("__blk").rangeBetween(-1, -1)
    total = {k: F.coalesce(F.sum(v).over(past), F.lit(0.0)) + 2.0 ** (-size / halflife) * F.coalesce(F.sum(v).over(before), F.lit(0.0)) for k, v in {"__sw": F.col("__w"), "__sv": F.col("__w") * F.col(value)}.items()}
    return d.withColumns(total).withColumn(name, F.when(F.col("__sw") > 0, F.col("__sv") / F.col("__sw"))).drop("__i", "__blk", "__w", *total)


def chain_ahead(df: DataFrame, by: list[str], day: str, value: str, k: int, most_step: int) -> DataFrame:
    """Endpoint and path extremes k steps ahead, only along steps of at most most_step days."""
    w = Window.partitionBy(*by).orderBy(day)
    d = df.withColumn("__ok", (F.datediff(F.lead(day).over(w), day) <= most_step).cast("int"))
    ahead, steps = w.rowsBetween(1, k), w.rowsBetween(0, k - 1)
    whole = (F.count("__ok").over(steps) == k) & (F.min("__ok").over(steps) == 1)
    at = {"end": F.lead(value, k).over(w), "path_min": F.min(value).over(ahead), "path_max": F.max(value).over(ahead)}
    return d.withColumns({f"{c}_{k}": F.when(whole, v) for c, v in at.items()}).drop("__ok")


def first_hit(df: DataFrame, by: list[str], order: str, value: str, limit: Column, n: int, name: str = "fill") -> DataFrame:
    """The first of the next n values that is at or below the limit, else the n-th; null near the end."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__next", F.collect_list(value).over(w.rowsBetween(1, n))).withColumn("__limit", limit)
    hit = F.try_element_at(F.filter("__next", lambda x: x <= F.col("__limit")), F.lit(1))
    return d.withColumn(name, F.when(F.size("__next") == n, F.coalesce(hit, F.try_element_at("__next", F.lit(n))))).drop("__next", "__limit")


def back_adjust(df: DataFrame, by: list[str], order: str, value: str, jump: Column, name: str = "adjusted") -> DataFrame:
    """Multiply everything before each flagged jump by its ratio, so that the level is continuous up to the last value."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__r", F.when(jump, F.ln(F.col(value) / F.lag(value).over(w))).otherwise(0.0))
    later = F.coalesce(F.sum("__r").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return d.withColumn(name, F.col(value) * F.exp(later)).drop("__r")


def seasonal_change(df: DataFrame, by: list[str], day: str, value: str, days: int, name: str) -> DataFrame:
    """Value against the value exactly `days` days before: an equi join, so gaps give null."""
    past = df.select(*by, F.date_add(day, days).alias(day), F.col(value).alias("__p"))
    return df.join(past, [*by, day], "left").withColumn(name, F.col(value) - F.col("__p")).drop("__p")


def z_score(df: DataFrame, by: list[str], order: str, value: str, n: int, least: int, name: str = "z") -> DataFrame:
    """Value against mean and deviation of the last n rows, itself included."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn(name, F.when((F.count(value).over(w) >= least) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd)))


def centred_trend(df: DataFrame, by: list[str], order: str, value: str, k: int, name: str = "trend") -> DataFrame:
    """Mean of the k rows on both sides; null at the ends."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-k, k)
    return df.withColumn(name, F.when(F.count(value).over(w) == 2 * k + 1, F.avg(value).over(w)))


def autocorrelation(df: DataFrame, by: list[str], order: str, value: str, lags: int) -> DataFrame:
    """Autocorrelations up to `lags` and the Ljung-Box statistic, from lag products."""
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumn("__x", F.col(value) - F.avg(value).over(whole))
    d = d.select(*by, "__x", *[F.lag("__x", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)])
    s2 = F.sum(F.col("__x") * F.col("__x"))
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.try_divide(F.sum(F.col("__x") * F.col(f"__l{k}")), s2).alias(f"acf{k}") for k in range(1, lags + 1)])
    q = sum((F.try_divide(F.col(f"acf{k}") * F.col(f"acf{k}"), F.col("n") - k) for k in range(2, lags + 1)), F.try_divide(F.col("acf1") * F.col("acf1"), F.col("n") - 1))
    return out.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * q)


def variance_ratio(df: DataFrame, by: list[str], order: str, log_value: str, k: int) -> DataFrame:
    """Variance of k-step moves over k times that of one-step moves."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__1", F.col(log_value) - F.lag(log_value).over(w)).withColumn("__k", F.col(log_value) - F.lag(log_value, k).over(w))
    return d.groupBy(*by).agg(F.try_divide(F.var_samp("__k"), k * F.var_samp("__1")).alias("variance_ratio"), F.count("__k").alias("n"))


def typical_move(df: DataFrame, by: list[str], day: str, value: str, back: int, window: int, now: str, least: int = 15) -> DataFrame:
    """Median absolute change against `back` days before, over the last `window` days up to `now`; null below `least` pairs."""
    past = df.select(*by, F.date_add(day, back).alias(day), F.col(value).alias("__p"))
    d = df.join(past, [*by, day]).where((F.col(day) <= F.lit(now).cast("date")) & (F.col(day) > F.date_sub(F.lit(now).cast("date"), window)))
    return d.groupBy(*by).agg(F.when(F.count("__p") >= least, F.percentile(F.abs(F.col(value) - F.col("__p")), F.lit(0.5))).alias("typical_move"), F.count("__p").alias("n"))
