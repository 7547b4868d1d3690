"""Estimates on days whose fix is stale: bands for each freshness, and strategies that fall back on one another.

A day's fit, bands and histories come from rows strictly before it. Histories are arrays of the last values (`plans.robust`), so a day is
scored where it stands in one sort of its key; a fallback is a null that the next strategy fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.plans import robust as R


def scored_days(readings: DataFrame, fixes: DataFrame, by: list[str], day: str, reading: str, fix: str, level: float = 0.8, most_age: int = 14, least: int = 30, least_stale: int = 8, halflife: float = R.HALF_LIFE) -> DataFrame:
    """Each reading with the latest fix that is younger than `most_age` days: gap_days, estimate, half_width and half_width_stratified.

    The line is fitted on earlier days that had a fix of their own (`least` of them, else the day is not scored), and half_width is the weighted
    `level` quantile of their residuals. On a stale day the stratified one takes the residuals, under this day's line, of earlier stale days; with fewer
    than `least_stale` of them it is half_width, and `fell_back` is true. Readings and fixes hold one row for each key and day; rows with a null
    value or day are left out. previous_day, previous: the latest reading before, of whatever age.
    """
    w = Window.partitionBy(*by).orderBy(day)
    y = readings.where(F.col(reading).isNotNull() & F.col(day).isNotNull())
    y = y.withColumns({"previous_day": F.lag(day).over(w), "previous": F.lag(reading).over(w)})
    x = fixes.where(F.col(fix).isNotNull()).select(*by, F.col(day).alias("__fix_day"), F.col(fix).alias("__fix"))
    d = asof_join(y, x, by, day, "__fix_day", ["__fix"], tolerance=f"{most_age - 1} days", tolerance_keeps_row=False)
    d = d.withColumn("gap_days", F.datediff(day, "__fix_day"))
    point = F.struct(F.col("__fix").cast("double").alias("x"), F.col(reading).cast("double").alias("y"))
    d = R.recent(d, by, day, F.when(F.col("gap_days") == 0, point), "__fresh", seen="n_train")
    d = R.recent(d, by, day, F.when(F.col("gap_days") > 0, point), "__stale").where(F.col("n_train") >= least)
    d = d.withColumn("__fit", R.huber_fit(F.col("__fresh"), halflife))
    d = d.withColumns({"estimate": F.col("__fit.slope") * F.col("__fix") + F.col("__fit.intercept"), "half_width": R.residual_quantile(F.col("__fresh"), F.col("__fit"), level, halflife)})
    enough = (F.col("gap_days") > 0) & (F.size("__stale") >= least_stale)
    d = d.withColumn("__own", R.residual_quantile(F.when(enough, F.col("__stale")), F.col("__fit"), level, halflife))
    d = d.withColumns({"half_width_stratified": F.coalesce("__own", "half_width"), "fell_back": (F.col("gap_days") > 0) & F.col("__own").isNull()})
    return d.drop("__fresh", "__stale", "__fit", "__own", "__fix", "__fix_day")


def coverage(days: DataFrame, by: list[str], reading: str) -> DataFrame:
    """For each key and stratum (same_day, carry_forward): days, days inside each band, mean half widths and fallbacks."""
    off = F.abs(F.col(reading) - F.col("estimate"))
    stratum = F.when(F.col("gap_days") > 0, "carry_forward").otherwise("same_day")
    inside = lambda c: F.sum((off <= F.col(c)).cast("int"))
    return days.groupBy(*by, stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), inside("half_width").alias("in_band"), inside("half_width_stratified").alias("in_stratified"), F.avg("half_width").alias("mean_half_width"), F.avg("half_width_stratified").alias("mean_stratified"), F.sum(F.col("fell_back").cast("int")).alias("fallback_days"))


def stale_day_strategies(days: DataFrame, by: list[str], day: str, reading: str, benchmark: str, level: float = 0.8, most_carry: int = 4, least_errors: int = 8, least_pairs: int = 8, halflife: float = R.HALF_LIFE) -> DataFrame:
    """Scored days with three strategies: s1 the line; s2 on stale days the latest reading, not older than `most_carry` days, else s1; s3 on stale days
    with a benchmark that times the weighted median of reading / benchmark of earlier such days, else s2, and null where it was not tried.

    Each strategy's half width is the weighted quantile of its own errors on earlier stale days on which it did not fall back, else the half
    width of the strategy before it. *_fallback says which of them fell back.
    """
    stale = F.col("gap_days") > 0
    carried = F.when(stale & (F.datediff(day, "previous_day") <= most_carry), F.col("previous"))
    d = days.withColumn("__carried", carried.cast("double"))
    d = R.recent(d, by, day, F.abs(F.col("__carried") - F.col(reading)), "__e2")
    w2 = R.recent_quantile(F.when(stale & (F.size("__e2") >= least_errors), F.col("__e2")), level, halflife)
    d = d.withColumn("__w2", w2).withColumns({"s1_estimate": F.col("estimate"), "s1_half_width": F.col("half_width"), "s2_estimate": F.coalesce("__carried", "estimate"), "s2_half_width": F.coalesce("__w2", "half_width")})
    d = d.withColumns({"s2_estimate_fallback": stale & F.col("__carried").isNull(), "s2_band_fallback": stale & F.col("__w2").isNull()})
    tried = stale & F.col(benchmark).isNotNull()
    d = R.recent(d, by, day, F.when(tried & (F.col(benchmark) != 0), F.col(reading) / F.when(F.col(benchmark) != 0, F.col(benchmark))), "__ratios")
    d = d.withColumn("__own3", R.recent_quantile(F.when(tried & (F.size("__ratios") >= least_pairs), F.col("__ratios")), 0.5, halflife) * F.col(benchmark))
    d = R.recent(d, by, day, F.abs(F.col("__own3") - F.col(reading)), "__e3")
    d = d.withColumn("__w3", R.recent_quantile(F.when(tried & (F.size("__e3") >= least_errors), F.col("__e3")), level, halflife))
    d = d.withColumns({"s3_estimate": F.when(tried, F.coalesce("__own3", "s2_estimate")), "s3_half_width": F.when(tried, F.coalesce("__w3", "s2_half_width")), "s3_estimate_fallback": F.when(tried, F.col("__own3").isNull()), "s3_band_fallback": F.when(tried, F.col("__w3").isNull())})
    return d.drop("__carried", "__e2", "__w2", "__ratios", "__own3", "__e3", "__w3")
