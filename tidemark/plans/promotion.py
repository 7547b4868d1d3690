"""A champion and its challengers: running long-run variance, bounds that hold at every look, the comparison and who is promoted.

The bound after n days is mean - sqrt(inflation * long-run variance) * s(n) / n. s(n) is where a one-sided normal mixture martingale reaches 1 / level, so
by Ville's inequality the bound may be looked at after every day. All sums are windows; s is worked out once for each n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.demotion import binomial_lower

NEWTON, TERMS = 40, 110  # steps, and terms of the normal distribution's series; enough for arguments below 8


def running_long_run_variance(df: DataFrame, by: list[str], order: str, value: str, lags: int, name: str = "lrv") -> DataFrame:
    """Newey-West variance (Bartlett weights, centred on the running mean, divided by n) of the rows so far; null for the first row.

    Also n, mean and var, the plain variance. Rows with a null value are left out.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = F.col(value).cast("double")
    d = df.where(F.col(value).isNotNull()).withColumn("n", F.row_number().over(w)).withColumns({"mean": F.avg(e).over(upto), "__q0": F.sum(e * e).over(upto)})
    n, m = F.col("n"), F.col("mean")
    total = F.col("__q0") - n * m * m
    d = d.withColumn("var", F.greatest(total / n, F.lit(0.0)))
    for k in range(1, lags + 1):
        past = F.lag(value, k).over(w).cast("double")
        d = d.withColumns({"__p": e * past, "__z": past, "__h": F.when(n > k, e)})
        d = d.withColumns({f"__{c}{k}": F.coalesce(F.sum(f"__{c}").over(upto), F.lit(0.0)) for c in "pzh"})
    for k in range(1, lags + 1):
        total = total + F.when(n > k, 2 * (1 - k / (lags + 1)) * (F.col(f"__p{k}") - m * (F.col(f"__h{k}") + F.col(f"__z{k}")) + (n - k) * m * m)).otherwise(0.0)
    d = d.withColumn(name, F.when(n > 1, F.greatest(total / n, F.lit(0.0))))
    return d.drop("__q0", "__p", "__z", "__h", *[f"__{c}{k}" for k in range(1, lags + 1) for c in "pzh"])


def mixture_distance(n: Column, level: float, mix_sd: float) -> Column:
    """s(n): log(2 / mix_sd) - log(a) / 2 + s^2 / (2 a) + log Phi(s / sqrt(a)) = log(1 / level) with a = n + 1 / mix_sd^2, by Newton's steps from above."""
    a = n + 1 / mix_sd**2
    aim = math.log(1 / level) - math.log(2 / mix_sd) + F.ln(a) / 2

    def step(s: Column, _: Column) -> Column:
        z = s / F.sqrt(a)
        density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        start = F.struct(z.alias("term"), z.alias("sum"))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda x, k: F.struct((x["term"] * z * z / (2 * k + 1)).alias("term"), (x["sum"] + x["term"] * z * z / (2 * k + 1)).alias("sum")))["sum"]
        below = 0.5 + density * series
        return s - (s * s / (2 * a) + F.ln(below) - aim) / (s / a + density / (F.sqrt(a) * below))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.sqrt(2 * a * (aim + math.log(2))), step)


def anytime_lower(df: DataFrame, by: list[str], order: str, value: str, level: float, lags: int, mix_sd: float, least: int = 20, inflation: float = 1.0, floor_iid: bool = True) -> DataFrame:
    """Rows with a value, and n, mean and lower: the bound on the mean after each row; null before `least` rows and without variance."""
    d = running_long_run_variance(df, by, order, value, lags)
    var = F.greatest("lrv", "var") if floor_iid else F.col("lrv")
    looks = d.select("n").where(F.col("n") >= least).distinct().withColumn("__s", mixture_distance(F.col("n").cast("double"), level, mix_sd))
    d = d.withColumn("__v", var * inflation).join(looks, "n", "left")
    return d.withColumn("lower", F.when((F.col("__v") > 0) & (F.col("n") >= least), F.col("mean") - F.sqrt("__v") * F.col("__s") / F.col("n"))).drop("__v", "__s", "lrv", "var")


def compared(df: DataFrame, by: list[str], challenger: str, day: str, *, loss_a: str, loss_b: str, hit_a: str, hit_b: str, covered: str, registered: str | None = None, min_gain: float = 0.05, level: float = 0.05 / 3, lags: int = 4, mix_sd: float = 0.3, least: int = 20, horizon: int = 180, nominal: float = 0.8, coverage_alpha: float = 0.05, inflation: float = 1.5) -> DataFrame:
    """One row for each key and challenger: the comparison on the days that both issued.

    df: a row for each day of the champion and each challenger; loss_b is null where the challenger issued nothing, hit_* (direction right) where nothing
    moved, covered where there was no range. The horizon counts the champion's days after `registered` (a date column; null: the first common
    day) up to the last common one, also those that the challenger missed.
    """
    keys = [*by, challenger]
    both = F.col(loss_a).isNotNull() & F.col(loss_b).isNotNull()
    d = df.withColumn("__e", F.when(both, (1 - min_gain) * F.col(loss_a) - F.col(loss_b)))
    bounds = anytime_lower(d, keys, day, "__e", level, lags, mix_sd, least, inflation)
    last = bounds.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by("lower", day).alias("__lower"))
    moved = both & F.col(hit_a).isNotNull() & F.col(hit_b).isNotNull()
    span = d.withColumns({"__first": F.min(F.when(both, F.col(day))).over(Window.partitionBy(*keys)), "__last": F.max(F.when(both, F.col(day))).over(Window.partitionBy(*keys))})
    since = F.coalesce(F.col(registered), F.col("__first")) if registered else F.col("__first")
    mean = lambda c, ok: F.avg(F.when(ok, F.col(c).cast("double")))
    g = span.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("n"), F.first("__first").alias("first_day"), F.first("__last").alias("last_day"), mean(loss_a, both).alias("mae_champion"), mean(loss_b, both).alias("mae_challenger"),
        F.count(F.when(both, F.col(covered))).alias("coverage_n"), F.coalesce(F.sum(F.when(both, F.col(covered).cast("int"))), F.lit(0)).alias("__hits"),
        mean(hit_a, moved).alias("direction_champion"), mean(hit_b, moved).alias("direction_challenger"), F.count(F.when((F.col(day) > since) & (F.col(day) <= F.col("__last")), 1)).alias("days_since_registration"),
    )
    g = g.join(last, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    scored = F.col("n") >= 2
    looks = scored & (F.col("n") >= least) & F.col("__lower").isNotNull()
    p = F.when(F.col("coverage_n") > 0, binomial_lower(F.col("__hits"), F.col("coverage_n"), nominal))
    return g.select(
        *keys, "n", "first_day", "last_day", F.when(scored, "scored").otherwise("too early").alias("status"), "mae_champion", "mae_challenger",
        F.when(scored, F.when(F.col("mae_champion") > 0, 1 - F.col("mae_challenger") / F.when(F.col("mae_champion") > 0, F.col("mae_champion"))).otherwise(0.0)).alias("gain"),
        F.when(looks & (F.col("mae_champion") > 0), min_gain + F.col("__lower") / F.when(F.col("mae_champion") > 0, F.col("mae_champion"))).alias("lower_bound"), looks.alias("looks_started"), F.coalesce(looks & (F.col("__lower") > 0), F.lit(False)).alias("lower_bound_clears"),
        "coverage_n", p.alias("coverage_p_below"), F.coalesce(p >= coverage_alpha, F.lit(False)).alias("coverage_ok"), "direction_champion", "direction_challenger",
        F.coalesce(F.col("direction_challenger") >= F.col("direction_champion"), F.lit(False)).alias("direction_ok"), "days_since_registration", F.greatest(F.lit(horizon) - F.col("days_since_registration"), F.lit(0)).alias("horizon_left"), (F.col("days_since_registration") >= horizon).alias("retired"),
    )


def promoted(comparison: DataFrame, by: list[str], challenger: str, live: list[str], blocked: dict[str, str] | None = None) -> DataFrame:
    """The comparison with blocked_reason, promotable (every condition holds) and promoted: the one with the lowest mean error of a key, the first by name of equals."""
    reason = F.coalesce(*[F.when(F.col(challenger) == c, F.lit(why)) for c, why in (blocked or {}).items()], F.lit(None).cast("string"))
    ok = (F.col("status") == "scored") & F.col(challenger).isin(live) & F.col("blocked_reason").isNull() & ~F.col("retired") & F.col("looks_started") & F.col("lower_bound_clears") & F.col("coverage_ok") & F.col("direction_ok")
    d = comparison.withColumn("blocked_reason", reason).withColumn("promotable", F.coalesce(ok, F.lit(False)))
    best = F.min(F.when(F.col("promotable"), F.struct("mae_challenger", challenger))).over(Window.partitionBy(*by))[challenger]
    return d.withColumn("promoted", F.coalesce(F.col(challenger) == best, F.lit(False)))
