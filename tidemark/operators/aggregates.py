"""Aggregates: last values, weighted statistics, rates with intervals, array and stratum summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import wilson
from tidemark.operators import hot


def last_per_group(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each group's row that is last in order; no sort, so partial sums apply."""
    s = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*by).agg(s.alias("__l")).select(*by, *[F.col("__l")[c].alias(c) for c in columns])


def last_known_per_group(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per column the last value that is not null."""
    return df.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def local_day(ts: str | Column, tz: str = "Asia/Kolkata") -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.from_utc_timestamp(c.cast("timestamp"), tz))


def last_per_local_day(df: DataFrame, by: list[str], ts: str, columns: list[str], tz: str = "Asia/Kolkata", tie: list[str] | None = None) -> DataFrame:
    d = df.withColumn("local_day", local_day(ts, tz))
    return last_per_group(d, [*by, "local_day"], [ts, *(tie or [])], columns)


def fuse(df: DataFrame, by: list[str], source: str, value: str, weights: dict[str, float], default: float = 1.0, band: float = 0.05) -> DataFrame:
    """Weighted mean of sources, the largest relative deviation from it, whether that is within the band, and the weights used."""
    w = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col(source)], F.lit(default)) if weights else F.lit(default)
    d = df.where(F.col(value).isNotNull()).withColumn("__w", w)
    m = d.groupBy(*by).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("fused"), F.count(F.lit(1)).alias("n"), F.max(value).alias("__hi"), F.min(value).alias("__lo"), F.sort_array(F.collect_set(F.struct(source, "__w"))).alias("weights"))
    dev = F.greatest(F.col("__hi") - F.col("fused"), F.col("fused") - F.col("__lo")) / F.abs("fused")
    return m.withColumn("max_deviation", dev).withColumn("agree", F.col("max_deviation") <= band).drop("__hi", "__lo")


def success_rate(df: DataFrame, by: list[str], ok: Column, z: float = 1.96) -> DataFrame:
    d = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"), z)
    return d.withColumn("rate", F.col("k") / F.col("n")).withColumn("lower", lo).withColumn("upper", hi)


def gaps(df: DataFrame, by: list[str], ts: str, now: Column | None = None) -> DataFrame:
    """Distribution of the hours between consecutive rows; with `now` the open gap counts for the longest."""
    w = Window.partitionBy(*by).orderBy(ts)
    h = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 3.6e9
    d = df.withColumn("__g", h)
    out = d.groupBy(*by).agg(F.count("__g").alias("n_gaps"), F.percentile("__g", F.lit(0.5)).alias("median_gap"), F.percentile("__g", F.lit(0.9)).alias("p90_gap"), F.max("__g").alias("max_gap"), F.max(ts).alias("__last"))
    if now is not None:
        open_gap = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("__last").cast("timestamp"))) / 3.6e9
        out = out.withColumn("max_gap", F.greatest("max_gap", open_gap))
    return out.drop("__last")


def weighted_percentile(df: DataFrame, by: list[str], value: str, weight: str, p: float, name: str = "weighted_percentile") -> DataFrame:
    """The first value, in order, at which the summed weight reaches p of the whole: a step function.

    Equal values are added up first, so each group sorts its distinct values only.
    """
    d = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*by).orderBy(value)
    d = d.withColumn("__c", F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum("__w").over(Window.partitionBy(*by)))
    return d.where(F.col("__c") >= F.lit(p) * F.col("__t")).groupBy(*by).agg(F.min(value).alias(name))


def higher_quantile(values: Column, p: float) -> Column:
    """The order statistic of rank ceil((n + 1) p), capped at n, of an array."""
    n = F.size(values)
    k = F.least(F.ceil((n + 1) * p), n).cast("int")
    return F.when(n > 0, F.try_element_at(F.sort_array(values), k))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("std"), F.percentile(value, F.lit(0.1)).alias("p10"), F.percentile(value, F.lit(0.9)).alias("p90"))


def by_strata(df: DataFrame, strata: dict[str, Column], *aggregates: Column) -> DataFrame:
    """Aggregates for overlapping strata: a row counts in each stratum whose condition holds, in one pass."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in strata.items()]))
    return df.withColumn("stratum", F.explode(names)).groupBy("stratum").agg(*aggregates)


def transitions(df: DataFrame, by: list[str], order: str, category: str, values: list[str]) -> DataFrame:
    """Counts of category -> next category, one column for each."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__from", F.lag(category).over(w)).where("__from is not null")
    return d.groupBy(F.col("__from").alias("from_category")).pivot(category, values).count().na.fill(0)


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of p, the last one closed: count, mean p, mean y."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def ece(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    return calibration_bins(df, p, y, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def proper_scores(df: DataFrame, by: list[str], p: str, y: str, clip: float = 1e-6) -> DataFrame:
    """Brier score, log loss of clipped probabilities, accuracy at one half, Brier skill against the base rate."""
    q, t = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(p))), F.col(y).cast("double")
    base = F.avg(t) * (1 - F.avg(t))
    brier = F.avg((F.col(p) - t) * (F.col(p) - t))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), brier.alias("brier"), F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("log_loss"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y).cast("int")).cast("double")).alias("accuracy"), F.when(base > 0, 1 - brier / F.when(base > 0, base)).alias("skill"))


def coverage(df: DataFrame, by: list[str], lower: str, upper: str, actual: str) -> DataFrame:
    """Share of actuals within their band, among rows where all three are known."""
    whole = F.col(lower).isNotNull() & F.col(upper).isNotNull() & F.col(actual).isNotNull()
    inside = (F.col(actual) >= F.col(lower)) & (F.col(actual) <= F.col(upper))
    return df.groupBy(*by).agg(F.sum(whole.cast("int")).alias("n"), F.avg(F.when(whole, inside.cast("double"))).alias("coverage"), F.avg(F.when(whole, F.col(upper) - F.col(lower))).alias("mean_width"))


def horizon_errors(df: DataFrame, actuals: str, forecasts: str) -> DataFrame:
    """Mean absolute error by place in two array columns; a missing element leaves its horizon out."""
    z = F.arrays_zip(F.col(actuals).alias("a"), F.col(forecasts).alias("f"))
    d = df.select(F.posexplode(z).alias("h", "z"))
    return d.where("z.a is not null and z.f is not null").groupBy((F.col("h") + 1).alias("horizon")).agg(F.avg(F.abs(F.col("z.a") - F.col("z.f"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def origin_slope(x: str, y: str) -> Column:
    """Slope of the line through the origin."""
    return F.sum(F.col(x) * F.col(y)) / F.when(F.sum(F.col(x) * F.col(x)) > 0, F.sum(F.col(x) * F.col(x)))


def null_counts(df: DataFrame, columns: list[str]) -> Column:
    """How many of the columns are null, in each row."""
    return sum((F.col(c).isNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNull().cast("int"))


def monthly_sample(df: DataFrame, day: str, value: str) -> DataFrame:
    """Median, count, least and most of each month between the first and last; months without data have count 0."""
    m = df.groupBy(F.trunc(day, "month").alias("month")).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    ends = m.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month")).join(m, "month", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def average_ranks(df: DataFrame, by: list[str], c: str, name: str) -> DataFrame:
    """For each key (as __by_...) and value (as __value) the average rank of its rows: equal rows are counted first, and a key's values are cut into pieces."""
    d = hot.pieces(df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n")), by, c, name="__piece")
    keys = [F.col(k).alias(f"__by_{k}") for k in by]
    ahead = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = d.groupBy(*keys, F.col("__piece").alias("__at")).agg(F.sum("__n").alias("__all"))
    total = total.select(*[f"__by_{k}" for k in by], "__at", ahead("__all", Window.partitionBy(*[f"__by_{k}" for k in by]).orderBy("__at")).alias("__carry"))
    d = d.withColumn("__here", ahead("__n", Window.partitionBy(*by, "__piece").orderBy(c)))
    same = [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by]
    d = d.join(F.broadcast(total), [*same, F.col("__piece") == F.col("__at")])
    return d.select(*[f"__by_{k}" for k in by], F.col(c).alias("__value"), (F.col("__carry") + F.col("__here") + (F.col("__n") + 1) / 2).alias(name))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average-tie ranks; no task sorts or holds the rows of a key."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    for c, name in ((x, "__x"), (y, "__y")):
        ranks = average_ranks(d.select(*by, c), by, c, name)
        d = d.join(ranks, [*[F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by], F.col(c) == F.col("__value")]).drop("__value", *[f"__by_{k}" for k in by])
    return d.groupBy(*by).agg(F.corr("__x", "__y").alias("spearman"), F.corr(x, y).alias("pearson"), F.count(F.lit(1)).alias("n"))


def quantile_buckets(df: DataFrame, by: list[str], value: str, cuts: list[float], name: str = "bucket") -> DataFrame:
    """Bucket by the group's own quantiles, closed on the right."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(c) for c in cuts])).alias("__q"))
    d = df.join(q, by) if by else df.crossJoin(F.broadcast(q))
    return d.withColumn(name, F.size(F.filter("__q", lambda c: F.col(value) > c))).drop("__q")


def array_minima(df: DataFrame, by: list[str], actual: str, forecast: str, limit: str) -> DataFrame:
    """Of forecast paths: precision and recall of dips to the limit, and the median error of the dip's place."""
    hit, said = F.array_min(actual) <= F.col(limit), F.array_min(forecast) <= F.col(limit)
    place = F.abs(F.array_position(actual, F.array_min(actual)) - F.array_position(forecast, F.array_min(forecast)))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum((hit & said).cast("int")), F.sum(said.cast("int"))).alias("precision"), F.try_divide(F.sum((hit & said).cast("int")), F.sum(hit.cast("int"))).alias("recall"), F.percentile(place, F.lit(0.5)).alias("timing_error"))


def direction_accuracy(df: DataFrame, by: list[str], start: str, forecast: str, actual: str) -> DataFrame:
    """Share of forecasts on the right side of the start; a zero move counts as wrong."""
    ok = F.signum(F.col(forecast) - F.col(start)) * F.signum(F.col(actual) - F.col(start)) > 0
    return df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("accuracy"))
