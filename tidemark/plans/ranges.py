"""Interval baselines, size-bucketed ranges, trend residuals, decompositions and evaluations of signals.

All are window sums, sorted frames of a stated length, or one aggregate for each key; nothing runs in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import quantile_over, rows_before
from tidemark.plans.walkforward import matured_sums


def array_quantile(values: Column, q: float) -> Column:
    """Linear quantile of an array of numbers; null for an empty one."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(s, low + 1), F.try_element_at(s, F.ceil(at).cast("int") + 1)
    return F.when(F.size(s) > 0, a + (b - a) * (at - low))


def ewma_variance(df: DataFrame, by: list[str], order: str, ret: str, lam: float = 0.94, seed: int = 30, name: str = "variance") -> DataFrame:
    """The recursive variance lam * before + (1 - lam) * ret^2, begun with the sample variance of the first `seed` returns.

    Written as decayed sums over the block of 50 half-lives a row is in and the one before, so no state is carried row by row.
    Rows without a return are left out; a lone return begins with its square.
    """
    size = math.ceil(50 * math.log(0.5) / math.log(lam))
    w = Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(ret).isNotNull()).withColumn("__i", F.row_number().over(w) - 1).withColumn("__blk", F.floor(F.col("__i") / size))
    d = d.withColumn("__w", F.pow(F.lit(lam), (F.col("__blk") + 1) * size - F.col("__i"))).withColumn("__q", F.col("__w") * F.col(ret) * F.col(ret))
    first = F.when(F.col("__i") < seed, F.col(ret))
    start = F.coalesce(F.var_samp(first).over(Window.partitionBy(*by)), F.max(first * first).over(Window.partitionBy(*by)))
    own = F.sum("__q").over(Window.partitionBy(*by, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("__q").over(Window.partitionBy(*by).orderBy("__blk").rangeBetween(-1, -1)), F.lit(0.0))
    total = (own + lam**size * before) / F.col("__w")
    return d.withColumn(name, F.pow(F.lit(lam), F.col("__i") + 1) * start + (1 - lam) * total).drop("__i", "__blk", "__w", "__q")


def interval_sets(df: DataFrame, by: list[str], order: str, price: str, horizon: int, level: float = 0.8, z: float = 1.2815515655446004, window: int = 250, sample: int = 500, least: int = 60, lam: float = 0.94, seed: int = 30) -> DataFrame:
    """Bounds of the log return over `horizon` rows by three baselines, where its outcome is known.

    hv: normal, from the deviation of the last `window` returns; hs: quantiles of the last `sample` overlapping returns of the
    same horizon (`least` of them at least); ew: normal, from the recursive variance. Prices that are null or not positive are left out.
    """
    w = Window.partitionBy(*by).orderBy(order)
    x = F.log(F.col(price))
    d = df.where(F.col(price) > 0).withColumn("__r", x - F.lag(x).over(w)).withColumn("__h", x - F.lag(x, horizon).over(w)).withColumn("actual", F.lead(x, horizon).over(w) - x)
    last, past = w.rowsBetween(1 - window, 0), w.rowsBetween(1 - sample, 0)
    tail = (1 - level) / 2
    full = F.count("__r").over(last) == window
    enough = F.count("__h").over(past) >= least
    d = d.withColumns({"__hv": F.when(full, F.stddev_samp("__r").over(last) * math.sqrt(horizon)), "hs_low": F.when(enough, quantile_over("__h", tail, past)), "hs_high": F.when(enough, quantile_over("__h", 1 - tail, past))})
    d = ewma_variance(d, by, order, "__r", lam, seed, "__v")
    ew = F.when(F.row_number().over(w) >= seed, F.sqrt(F.col("__v") * horizon))
    d = d.withColumns({"hv_low": -z * F.col("__hv"), "hv_high": z * F.col("__hv"), "ew_low": -z * ew, "ew_high": z * ew})
    return d.where("actual is not null").drop("__r", "__h", "__hv", "__v")


def size_bucketed(df: DataFrame, by: list[str], order: str, size: str, score: str, window: int = 60, least: int = 20, least_bucket: int = 15, level: float = 0.8) -> DataFrame:
    """bucket, q_bucket and q_pooled: the range's half width in units of volatility, from the folds before.

    The last `window` folds are split at their median forecast size; a fold takes the quantile of its own half, or of all
    where the half has fewer than least_bucket folds. A fold without a size (no volatility) takes the pooled one; with fewer
    than `least` folds before it there is no range.
    """
    w = rows_before(by, [order], window)
    past = F.collect_list(F.when(F.col(size).isNotNull(), F.struct(F.col(size).alias("z"), F.col(score).alias("s")))).over(w)
    d = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__past", past).withColumn("__mid", quantile_over(size, 0.5, w))
    d = d.withColumn("q_pooled", F.when(F.col("__n") >= least, quantile_over(score, level, w))).withColumn("__high", F.col(size) > F.col("__mid"))
    d = d.withColumn("__own", F.transform(F.filter("__past", lambda p: (p["z"] > F.col("__mid")) == F.col("__high")), lambda p: p["s"]))
    half = F.when(F.col("__high"), F.lit("high")).otherwise(F.lit("low"))
    few = F.size("__own") < least_bucket
    none = F.col(size).isNull() | (F.size("__past") == 0)
    bucket = F.when(none, F.lit("pooled_no_size")).when(few, F.concat(half, F.lit("_pooled"))).otherwise(half)
    q = F.when(none | few, F.col("q_pooled")).otherwise(array_quantile(F.col("__own"), level))
    has = F.col("q_pooled").isNotNull()
    return d.withColumn("bucket", F.when(has, bucket)).withColumn("q_bucket", F.when(has, q)).drop("__n", "__past", "__mid", "__high", "__own")


def trend_residual(df: DataFrame, by: list[str], day: str, value: str, days: int = 30, least: int = 10, flat: float = 5.0) -> DataFrame:
    """For each key the median-of-slopes line through its last `days` days, the last value's residual in units of 1.4826 times the
    median absolute one, and the trend's state. Days are counted by place; a key has at most days + 1 points."""
    last = F.max(day).over(Window.partitionBy(*by))
    d = df.where(F.col(value).isNotNull()).withColumn("__end", last).where(F.datediff("__end", day) <= days)
    g = d.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).cast("double").alias("y")))), lambda p, i: F.struct(i.cast("double").alias("x"), p["y"].alias("y"))).alias("__p"))
    g = g.withColumn("n_days", F.size("__p")).where(F.col("n_days") >= least)
    slopes = F.expr("flatten(transform(__p, (a, i) -> transform(slice(__p, i + 2, n_days), b -> (b.y - a.y) / (b.x - a.x))))")
    g = g.withColumn("slope", array_quantile(slopes, 0.5))
    g = g.withColumn("__e", F.transform("__p", lambda p: p["y"] - F.col("slope") * p["x"])).withColumn("__c", array_quantile(F.col("__e"), 0.5))
    scale = 1.4826 * array_quantile(F.transform("__e", lambda e: F.abs(e - F.col("__c"))), 0.5)
    g = g.withColumn("residual", F.element_at("__e", -1) - F.col("__c")).withColumn("__s", scale)
    g = g.withColumn("residual_z", F.when(F.col("__s") > 0, F.col("residual") / F.col("__s")).otherwise(F.lit(0.0)))
    state = F.when(F.col("slope") <= -flat, "falling").when(F.col("slope") >= flat, "rising").otherwise("flat")
    return g.withColumn("state", state).drop("__p", "__e", "__c", "__s")


def log_shares(df: DataFrame, by: list[str], day: str, total: str, parts: list[str], days: int, most_rest: float = 15.0) -> DataFrame:
    """For each key the log change of `total` over its last `days` days, of each part, and of the rest (total over the parts' product).

    rest_share is in percent of the total's change; `valid` where it is at most most_rest and the total moved at all. Rows with a
    missing or not positive number are left out; keys with fewer than two rows in the window have nulls.
    """
    ok = F.lit(True)
    for c in (total, *parts):
        ok = ok & F.coalesce(F.col(c) > 0, F.lit(False))
    d = df.where(ok).withColumn("__end", F.max(F.when(ok, F.col(day))).over(Window.partitionBy(*by))).where(F.datediff("__end", day) <= days)
    logs = F.struct(*[F.log(F.col(c)).alias(c) for c in (total, *parts)])
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), F.min_by(logs, day).alias("__a"), F.max_by(logs, day).alias("__b"))
    change = {c: F.when(F.col("n_obs") > 1, F.col(f"__b.{c}") - F.col(f"__a.{c}")) for c in (total, *parts)}
    g = g.withColumns({f"change_{c}": e for c, e in change.items()})
    rest = F.col(f"change_{total}")
    for c in parts:
        rest = rest - F.col(f"change_{c}")
    still = F.abs(F.col(f"change_{total}")) < 1e-8
    g = g.withColumn("change_rest", rest)
    g = g.withColumn("rest_share", F.when(still, F.lit(0.0)).otherwise(F.abs(F.col("change_rest") / F.col(f"change_{total}")) * 100))
    return g.withColumn("valid", ~still & (F.col("rest_share") <= most_rest)).drop("__a", "__b")


def brier_skill(model: Column, base: Column) -> Column:
    """1 - model / base; null where the base has no error."""
    return F.when(base != 0, 1 - model / base)


def embargoed_evaluation(df: DataFrame, by: list[str], decision: str, label_day: str, p: str, y: str, embargo: int = 5, least: int = 30) -> DataFrame:
    """Brier scores, skill and accuracies of probabilities `p` of outcomes `y` against the share of outcomes known before.

    A fold's base share counts only outcomes whose label_day lies more than `embargo` days before the decision; folds with
    fewer than `least` of them, without a probability or without an outcome are not scored.
    """
    d = df.withColumn("__known", F.date_add(F.col(label_day), embargo))
    d = matured_sums(d.withColumn("__y", F.col(y).cast("double")), by, decision, "__known", {"__n": F.lit(1.0), "__up": F.col("__y")}).where(F.col("__n") >= least)
    d = d.where(F.col(p).isNotNull() & F.col("__y").isNotNull()).withColumn("__base", F.col("__up") / F.col("__n"))
    miss = lambda c: F.avg((F.col(c) - F.col("__y")) * (F.col(c) - F.col("__y")))
    right = lambda c: F.avg(((F.col(c) >= 0.5) == (F.col("__y") == 1)).cast("double"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), miss(p).alias("brier"), miss("__base").alias("base_brier"), right(p).alias("accuracy"), right("__base").alias("base_accuracy"))
    return g.withColumn("skill", brier_skill(F.col("brier"), F.col("base_brier")))


def hac_slope(df: DataFrame, by: list[str], order: str, x: str, y: str, lags: int) -> DataFrame:
    """For each key the line y = a + b x with a Newey-West error of b over `lags` rows, its plain error, t and the signal's effective count.

    Rows with a null are left out; keys where x does not vary, or with fewer than five rows, have null estimates.
    """
    key, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, order, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    for c, e in (("__n", F.count(F.lit(1))), ("__sx", F.sum("__x")), ("__sy", F.sum("__y")), ("__sxx", F.sum(F.col("__x") * F.col("__x"))), ("__sxy", F.sum(F.col("__x") * F.col("__y")))):
        d = d.withColumn(c, e.over(key))
    det = F.col("__n") * F.col("__sxx") - F.col("__sx") * F.col("__sx")
    d = d.withColumn("__det", F.when(det > 0, det))  # null where x does not vary
    d = d.withColumn("b", F.when(F.col("__det").isNotNull() & (F.col("__n") >= 5), (F.col("__n") * F.col("__sxy") - F.col("__sx") * F.col("__sy")) / F.col("__det"))).withColumn("a", (F.col("__sy") - F.col("b") * F.col("__sx")) / F.col("__n"))
    # A row's weight in b's error: b - true b is the sum of g.
    d = d.withColumn("__u", F.col("__y") - F.col("a") - F.col("b") * F.col("__x")).withColumn("__g", (F.col("__n") * F.col("__x") - F.col("__sx")) / F.col("__det") * F.col("__u"))
    total = F.col("__g") * F.col("__g")
    for j in range(1, lags + 1):
        total = total + 2 * (1 - j / (lags + 1)) * F.col("__g") * F.coalesce(F.lag("__g", j).over(w), F.lit(0.0))
    g = d.withColumn("__t", total).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__x").alias("__k"), F.first("a").alias("a"), F.first("b").alias("b"), F.sum("__t").alias("__v"), F.sum(F.col("__u") * F.col("__u")).alias("__uu"), F.first("__det").alias("__det"))
    left = F.when(F.col("n") > 2, F.col("n") - 2)
    g = g.withColumn("se_b", F.sqrt(F.greatest(F.col("__v") * F.col("n") / left, F.lit(0.0)))).withColumn("se_plain", F.sqrt(F.col("__uu") / left * F.col("n") / F.col("__det")))
    g = g.withColumn("t", F.when(F.col("se_b") > 0, F.col("b") / F.col("se_b"))).withColumn("effective_n", F.when(F.col("se_b") > 0, F.col("__k") * F.pow(F.col("se_plain") / F.col("se_b"), 2)))
    return g.select(*by, "n", "a", "b", "se_b", "se_plain", "t", "effective_n")


def position_today(df: DataFrame, by: list[str], day: str, value: str, as_of: str, window: int = 90, least: int = 10) -> DataFrame:
    """For keys that have a value on the as-of day: its percentile among the `window` values before and whether it is lower, usual or
    higher than their middle half (null with fewer than `least`). Keys without a value that day are left out."""
    w = rows_before(by, [day], window)
    past = F.collect_list(value).over(w)
    d = df.where(F.col(value).isNotNull()).withColumn("__past", past).withColumn("n_history", F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)))
    d = d.where(F.col(day) == F.lit(as_of).cast("date")).withColumn("__m", F.size("__past"))
    share = 100.0 * F.size(F.filter("__past", lambda v: v <= F.col(value))) / F.col("__m")
    low, high = array_quantile(F.col("__past"), 0.25), array_quantile(F.col("__past"), 0.75)
    kind = F.when(F.col(value) < low, "lower").when(F.col(value) > high, "higher").otherwise("usual")
    return d.withColumn("percentile", F.when(F.col("__m") > 0, share)).withColumn("category", F.when(F.col("__m") >= least, kind)).drop("__past", "__m")


def band_position(df: DataFrame, by: list[str], day: str, value: str, days: int = 90, least: int = 60, near: float = 2.0) -> DataFrame:
    """For each key its last value among those of its last `days` days: rounded percentile, the lowest, the distance from it in percent.

    One row for each key and day is expected; rows without a value are left out, and so are keys with fewer than `least` days.
    """
    d = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    d = d.withColumn("__end", F.max(day).over(w)).where(F.datediff("__end", day) <= days).withColumn("__now", F.max_by(value, day).over(w))
    share = F.avg((F.col(value) <= F.col("__now")).cast("double")) * 100
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_days"), F.first("__now").alias("current"), F.min(value).alias("low"), F.floor(share + 0.5).alias("percentile"))
    distance = (F.col("current") - F.col("low")) / F.col("low") * 100
    return g.where(F.col("n_days") >= least).withColumn("distance_pct", distance).withColumn("near_support", distance <= near)
