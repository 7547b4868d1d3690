"""A long history for a series that is young: a rolled future and a currency, lagged, with the duty in force, calibrated walk-forward on the young series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import step_schedule
from tidemark.operators.windows import quantile_over
from tidemark.plans import robust as R


def adjust_rolls(df: DataFrame, by: list[str], order: str, value: str, reference: str, sigmas: float = 6.0, window: int = 60, least: int = 20) -> DataFrame:
    """With `roll` and `adjusted`: a roll is a day on which the value's log return leaves that of a reference which never rolls.

    Its distance from the median of the last `window` divergences (this one included, `least` of them at least) is above `sigmas` sample deviations. From a roll
    on, the value is divided by the excess, so that moves before and after it stay and the jump goes. Values that are null or not positive give no return.
    """
    w = Window.partitionBy(*by).orderBy(order)
    step = lambda c: F.ln(F.when(F.col(c) > 0, F.col(c)) / F.lag(F.when(F.col(c) > 0, F.col(c))).over(w))
    last = w.rowsBetween(1 - window, 0)
    d = df.withColumn("__g", step(value) - step(reference))
    d = d.withColumns({"__n": F.count("__g").over(last), "__sd": F.stddev_samp("__g").over(last), "__x": F.col("__g") - quantile_over("__g", 0.5, last)})
    d = d.withColumn("roll", F.coalesce((F.col("__n") >= least) & (F.col("__sd") > 0) & (F.abs("__x") > sigmas * F.col("__sd")), F.lit(False)))
    excess = F.sum(F.when(F.col("roll"), F.col("__x")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("adjusted", F.col(value) * F.exp(-excess)).drop("__g", "__n", "__sd", "__x")


def long_history(drivers: DataFrame, target: DataFrame, steps: DataFrame, by: list[str], day: str, future: str, reference: str, currency: str, young: str, scale: float = 1.0, base_duty: float = 4.0, least: int = 30, halflife: float = R.HALF_LIFE) -> DataFrame:
    """One row for each driver row: raw_pre_duty, duty_pct, raw_with_duty, proxy, is_oos, roll_adjusted.

    drivers: one row for each key and day, filled forward. Day t uses the drivers of the row before it only. steps: (effective, pct), a level from that day on;
    base_duty before the first. The proxy of a day with a young value is the line fitted on all earlier such days, once there are `least` (is_oos); every other
    day takes the first of these lines, which for days before it is not out of sample, and without more than `least` such days the raw value.
    """
    w = Window.partitionBy(*by).orderBy(day)
    d = adjust_rolls(drivers, by, day, future, reference)
    d = d.select(*by, day, (F.lag("adjusted").over(w) * F.lag(currency).over(w) * scale).alias("raw_pre_duty"), F.coalesce(F.lag("roll").over(w), F.lit(False)).alias("roll_adjusted"))
    d = step_schedule(d, steps.select(F.col("effective").alias("__from"), F.col("pct").alias("duty_pct")), day, "__from", "duty_pct", base_duty)
    d = d.withColumn("raw_with_duty", F.col("raw_pre_duty") * (1 + F.col("duty_pct") / 100))
    d = d.join(target.select(*by, day, F.col(young).cast("double").alias("__y")), [*by, day], "left")
    both = F.col("raw_with_duty").isNotNull() & F.col("__y").isNotNull()
    d = R.recent(d, by, day, F.when(both, F.struct(F.col("raw_with_duty").alias("x"), F.col("__y").alias("y"))), "__past", seen="__n")
    d = d.withColumn("is_oos", both & (F.col("__n") >= least))
    d = d.withColumn("__fit", R.huber_fit(F.when(F.col("is_oos"), F.col("__past")), halflife))
    d = d.withColumn("__first", F.max(F.when(F.col("is_oos") & (F.col("__n") == least), F.col("__fit"))).over(Window.partitionBy(*by)))
    slope, intercept = (F.coalesce(F.col(f"__fit.{c}"), F.col(f"__first.{c}")) for c in ("slope", "intercept"))
    d = d.withColumn("proxy", F.coalesce(slope * F.col("raw_with_duty") + intercept, F.col("raw_with_duty")))
    return d.select(*by, day, "raw_pre_duty", "duty_pct", "raw_with_duty", "proxy", "is_oos", "roll_adjusted")
