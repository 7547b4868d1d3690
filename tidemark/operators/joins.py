"""Range, calendar and neighbourhood joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_windows(left: DataFrame, events: DataFrame, day: str, event_day: str, before: int, after: int, columns: list[str], priority: list[Column] | None = None, key: str | None = None) -> DataFrame:
    """left with the first event (by priority) whose neighbourhood [day - before, day + after] holds the row's day; null if none.

    Each event is spread over its own days, so the join is an equi join on the day and its size is events x window length.
    """
    spread = events.withColumn("__d", F.explode(F.sequence(F.date_sub(event_day, before), F.date_add(event_day, after))))
    order = priority or [F.col(event_day)]
    first = spread.withColumn("__r", F.row_number().over(Window.partitionBy("__d").orderBy(*order, *columns))).where("__r = 1").select("__d", event_day, *columns)
    return left.join(first, left[day] == first["__d"], "left").drop("__d")


def exclude_neighbourhood(left: DataFrame, events: DataFrame, day: str, event_day: str, k: int) -> DataFrame:
    """Rows whose day is not within k days of any event."""
    near = events.select(F.explode(F.sequence(F.date_sub(event_day, k), F.date_add(event_day, k))).alias("__d")).distinct()
    return left.join(near, left[day] == near["__d"], "left_anti")


def with_event_between(left: DataFrame, events: DataFrame, start: str, end: str, event_day: str) -> DataFrame:
    """Rows with an event in (start, end], each as often as it comes; a row with a null end has none.

    Each day that ends a span gets the last event up to it, in one pass over the days that occur (a calendar's worth), so rows are joined
    by equality and spans may be of any length.
    """
    marks = left.select(F.col(end).alias("__d"), F.lit(None).cast("date").alias("__e")).unionByName(events.select(F.col(event_day).alias("__d"), F.col(event_day).cast("date").alias("__e")))
    days = marks.where("__d is not null").groupBy("__d").agg(F.max("__e").alias("__e"))
    last = days.select("__d", F.last("__e", True).over(Window.orderBy("__d")).alias("__last")).where("__last is not null")
    return left.join(last, left[end] == last["__d"]).where(F.col("__last") > F.col(start)).drop("__d", "__last")


def ahead_on_calendar(df: DataFrame, by: list[str], day: str, n: int, columns: list[str], suffix: str) -> DataFrame:
    """The row n entries ahead on the key's own calendar of days present."""
    w = Window.partitionBy(*by).orderBy(day)
    return df.withColumns({f"{c}{suffix}": F.lead(c, n).over(w) for c in [day, *columns]})


def pairs_within(df: DataFrame, by: list[str], day: str, value: str, most_gap: int) -> DataFrame:
    """Consecutive pairs whose gap is at most most_gap days."""
    w = Window.partitionBy(*by).orderBy(day)
    d = df.select(*by, F.col(day).alias("d0"), F.col(value).alias("v0"), F.lead(day).over(w).alias("d1"), F.lead(value).over(w).alias("v1"))
    return d.where(F.datediff("d1", "d0") <= most_gap)


def theil_sen(df: DataFrame, by: list[str], x: str, y: str, most_points: int = 400) -> DataFrame:
    """Median slope of all pairs of points, and the median intercept.

    Pairs are built inside each group's own array, which is meant for short trailing windows: groups above most_points are refused.
    """
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    pts = pts.withColumn("p", F.when(F.size("p") <= most_points, F.col("p")).otherwise(F.raise_error(F.lit("too many points for pairwise slopes")).cast(pts.schema["p"].dataType)))
    slopes = pts.select(*by, "p", F.explode("p").alias("a")).select(*by, "p", F.explode(F.filter("p", lambda b: b["x"] > F.col("a")["x"])).alias("b"), "a")
    s = slopes.groupBy(*by).agg(F.expr("percentile((b.y - a.y) / (b.x - a.x), 0.5)").alias("slope"))
    rest = pts.select(*by, F.explode("p").alias("q")).join(s, by).groupBy(*by).agg(F.first("slope").alias("slope"), F.expr("percentile(q.y - slope * q.x, 0.5)").alias("intercept"), F.count(F.lit(1)).alias("n"))
    return rest


def expanding_pairs(train: DataFrame, test: DataFrame, label_day: str, decision_day: str) -> DataFrame:
    """Each test row with all training rows whose label was known strictly before it: for small fold tables and references only.

    Walk-forward fits in `plans.walkforward` use running sums in place of this product.
    """
    return test.join(train, train[label_day] < test[decision_day])


def splice(old: DataFrame, new: DataFrame, day: str, value: str, least_overlap: int = 20) -> DataFrame:
    """One series: new where it exists, before it the old one scaled by the median ratio over the common days.

    Fewer than least_overlap common days: the old part is left out.
    """
    n = new.select(day, F.col(value).alias("__n"))
    ratio = old.join(n, day).where((F.col(value) > 0) & F.col("__n").isNotNull()).agg(F.expr(f"percentile(__n / {value}, 0.5)").alias("__r"), F.count(F.lit(1)).alias("__k"), F.min(day).alias("__x"))
    first = new.agg(F.min(day).alias("__first"))
    scaled = old.crossJoin(F.broadcast(ratio)).crossJoin(F.broadcast(first)).where((F.col("__k") >= least_overlap) & (F.col(day) < F.col("__first")))
    return scaled.select(day, (F.col(value) * F.col("__r")).alias(value), F.lit("old").alias("segment")).unionByName(new.select(day, value, F.lit("new").alias("segment")))


def spine(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """Every day between each key's first and last one, with the row of that day where there is one."""
    days = df.groupBy(*by).agg(F.min(day).alias("__a"), F.max(day).alias("__b")).select(*by, F.explode(F.sequence("__a", "__b")).alias(day))
    return days.join(df, [*by, day], "left")


def forecasts_with_actuals(forecasts: DataFrame, actuals: DataFrame, by: list[str], target: str, issued: str) -> DataFrame:
    """Each target's latest forecast joined with its actual; a target counts once."""
    w = Window.partitionBy(*by, target).orderBy(F.col(issued).desc())
    return forecasts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").join(actuals, [*by, target])
