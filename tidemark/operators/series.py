"""Lags, runs, forward windows and alignments of series, and small counts over them."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import gap_segments


def lag_features(df: DataFrame, by: list[str], order: str, value: str, lags: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Values of the rows before, the step from the last one and the step to the next one (`target_delta`)."""
    w, v = Window.partitionBy(*by).orderBy(order), F.col(value)
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags} | {"step": v - F.lag(value).over(w), "target_delta": F.lead(value).over(w) - v})


def latest_run(df: DataFrame, by: list[str], day: str, most_gap: int) -> DataFrame:
    """Each key's last segment of rows whose steps are at most most_gap days."""
    d = gap_segments(df, by, day, most_gap)
    return d.withColumn("__last", F.max("segment").over(Window.partitionBy(*by))).where("segment = __last").drop("segment", "__last")


def weekday_number(day: str) -> Column:
    """Weekdays before a day, counted from a Monday: the difference of two is the number of weekdays from one to before the other."""
    n = F.datediff(day, F.lit("1969-12-29").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def forward_window(df: DataFrame, by: list[str], day: str, value: str, days: int = 7, most_weekdays: int = 2) -> DataFrame:
    """Least and greatest value and number of rows of the next 1 to `days` days, null unless that window is complete.

    Complete: from the row on, no step is longer than `most_weekdays` weekdays, up to and including the first row after the window, which proves that
    none is missing; and the window holds a row.
    """
    n = F.datediff(day, F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*by).orderBy(n)
    d = df.withColumn("__wd", weekday_number(day))
    d = d.withColumn("__run", F.sum(F.coalesce(F.col("__wd") - F.lag("__wd").over(w) > most_weekdays, F.lit(False)).cast("int")).over(w))
    ahead = w.rangeBetween(1, days)
    whole = (F.datediff(F.max(day).over(Window.partitionBy(*by, "__run")), day) > days) & (F.count(F.lit(1)).over(ahead) > 0)
    d = d.withColumns({"path_min": F.when(whole, F.min(value).over(ahead)), "path_max": F.when(whole, F.max(value).over(ahead)), "path_n": F.when(whole, F.count(value).over(ahead))})
    return d.drop("__wd", "__run")


def collapsed(df: DataFrame, by: list[str], order: str, up: str, n: int, edge: float) -> DataFrame:
    """Share of up calls in the last n rows, and whether it has collapsed to one side (at most edge, or at least 1 - edge)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    share = F.when(F.count(up).over(w) == n, F.avg(F.col(up).cast("double")).over(w))
    return df.withColumn("up_share", share).withColumn("collapsed", (F.col("up_share") <= edge) | (F.col("up_share") >= 1 - edge))


def aligned(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both series with all columns there: an outer align without its incomplete rows is an inner join."""
    return a.join(b, keys).na.drop(subset=columns)


def days_back(left: DataFrame, right: DataFrame, by: list[str], day: str, columns: list[str], days: int = 1) -> DataFrame:
    """left with the columns of the row exactly `days` calendar days before; null where there is none."""
    past = right.select(*by, F.date_add(day, days).alias(day), *[F.col(c).alias(f"{c}_lag") for c in columns])
    return left.join(past, [*by, day], "left")


def rescored(forecasts: DataFrame, actuals: DataFrame, by: list[str], day: str, forecast: str, value: str, h: int, most_gap: int) -> DataFrame:
    """Forecasts of one source against another's value h rows ahead, within segments without gaps only."""
    w = Window.partitionBy(*by, "segment").orderBy(day)
    target = gap_segments(actuals, by, day, most_gap).withColumn("actual", F.lead(value, h).over(w)).where("actual is not null")
    return forecasts.join(target.select(*by, day, F.col(value).alias("base"), "actual"), [*by, day]).withColumn("error", F.abs(F.col(forecast) - F.col("actual")))


def event_distances(df: DataFrame, events: DataFrame, day: str, event_day: str, none: int = 9999) -> DataFrame:
    """Days to the next event (0 on it) and since the last one; `none` where there is none or no day.

    Each day that occurs is placed between the events once, in one pass over a calendar's worth of days; rows are joined by equality.
    """
    marks = df.select(F.col(day).alias("__d"), F.lit(None).cast("date").alias("__e")).unionByName(events.select(F.col(event_day).alias("__d"), F.col(event_day).alias("__e")))
    days = marks.where("__d is not null").groupBy("__d").agg(F.max("__e").alias("__e"))
    w = Window.orderBy("__d")
    near = days.select("__d", F.last("__e", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__b"), F.first("__e", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("__a"))
    d = df.join(near, df[day] == near["__d"], "left")
    return d.withColumns({"days_to_next": F.coalesce(F.datediff("__a", day), F.lit(none)), "days_since_last": F.coalesce(F.datediff(day, "__b"), F.lit(none))}).drop("__d", "__a", "__b")


def causes(df: DataFrame, cause: str, ts: str, days: int, now: Column) -> DataFrame:
    """How often each cause occurs in the trailing window."""
    from tidemark.operators.predicates import trailing

    return trailing(df, ts, days, now).groupBy(cause).agg(F.count(F.lit(1)).alias("n"))


def groups_of(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Groups of at least `least` rows and their sizes."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, nulls included, and their share."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def bucket(x: Column, edges: list[float]) -> Column:
    """Number of the left-closed bin [edge k, edge k + 1) that holds x; null outside."""
    out = None
    for k, (a, b) in enumerate(pairwise(edges)):
        hit = (x >= a) & (x < b)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def bucket_agreement(df: DataFrame, by: list[str], a: str, b: str, edges: list[float]) -> DataFrame:
    """Share of rows whose two values fall into the same bin; rows with either outside do not count."""
    d = df.withColumn("__a", bucket(F.col(a), edges)).withColumn("__b", bucket(F.col(b), edges)).where("__a is not null and __b is not null")
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("__a") == F.col("__b")).cast("double")).alias("agreement"))


def decision_metrics(df: DataFrame, by: list[str], forecast: str, base: str, actual: str) -> DataFrame:
    """Mean absolute error and share of right directions of resolved decisions; null where a group has none."""
    done = F.col(actual).isNotNull() & F.col(forecast).isNotNull()
    right = F.signum(F.col(forecast) - F.col(base)) == F.signum(F.col(actual) - F.col(base))
    return df.groupBy(*by).agg(F.count(F.when(done, 1)).alias("resolved"), F.avg(F.when(done, F.abs(F.col(forecast) - F.col(actual)))).alias("mae"), F.avg(F.when(done & (F.col(actual) != F.col(base)), right.cast("double"))).alias("direction"))


def variant(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows of one variant."""
    return df.where(F.col(column) == name)
