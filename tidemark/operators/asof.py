"""As-of joins: for each left row the latest (or next) right row of its key, as one sort per key and no pairing.

The two sides are unioned and a window carries the last right row forward. A left row thus costs one row in one shuffle on the
key, whatever the number of right rows. Several right rows at one (key, time) must be reduced first (`last_per_group`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import hot

#: Schedules up to this many steps are one array in each task; longer ones are joined by pieces of time.
MOST_STEPS = 1000


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], direction: str = "backward", allow_exact: bool = True, tolerance: str | None = None, prefix: str = "", tolerance_keeps_row: bool = True) -> DataFrame:
    """left with `columns` of the right row that is in force (backward: latest not after; forward: first not before).

    allow_exact False makes it strict. tolerance, an interval such as '3 days', nulls matches further away (or drops the left
    row with tolerance_keeps_row False). The matched time is returned as prefix + right_ts.
    """
    back = direction == "backward"
    names = left.columns
    kept = [right_ts, *[c for c in columns if c != right_ts]]
    match = F.struct(*[F.col(c).alias(c) for c in kept])
    kind = right.select(match.alias("m")).schema["m"].dataType
    # at equal times the right row must come before the left one in reading order if exact matches count, else after
    right_side = 0 if allow_exact == back else 2
    l = left.select(*[F.col(c) for c in by], F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*names).alias("__left"), F.lit(None).cast(kind).alias("__match"))
    r = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [right_ts, *by]])).select(*[F.col(c) for c in by], F.col(right_ts).alias("__ts"), F.lit(right_side).alias("__side"), F.lit(None).cast(l.schema["__left"].dataType).alias("__left"), match.alias("__match"))
    w = Window.partitionBy(*by).orderBy("__ts", "__side")
    if back:
        got = F.last("__match", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        got = F.first("__match", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = l.unionByName(r).withColumn("__got", F.when(F.col("__ts").isNotNull(), got)).where("__left is not null")  # a row without a time matches nothing
    if tolerance:
        span = F.expr(f"INTERVAL {tolerance}")
        t, m = F.col("__left")[left_ts], F.col("__got")[right_ts]
        near = (m >= t - span) if back else (m <= t + span)
        if tolerance_keeps_row:
            out = out.withColumn("__got", F.when(near, F.col("__got")))
        else:
            out = out.where(near)
    return out.select(*[F.col("__left")[c].alias(c) for c in names], *[F.col("__got")[c].alias(prefix + c) for c in kept])


def known_before(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, known_at: str, columns: list[str], **options) -> DataFrame:
    """As-of on the moment a value became known; a value known at the very moment is not used (strict)."""
    return asof_join(left, right, by, left_ts, known_at, columns, allow_exact=False, **options)


def step_schedule(left: DataFrame, steps: DataFrame, left_ts: str, effective: str, value: str, default, by: list[str] | None = None) -> DataFrame:
    """The step in force at each row; `default` before the first one.

    A schedule of up to MOST_STEPS rows, which is counted first, becomes one sorted array that is looked up in each row: no sort of the left side.
    """
    if by:
        return asof_join(left, steps, by, left_ts, effective, [value]).withColumn(value, F.coalesce(value, F.lit(default))).drop(effective)
    if steps.limit(MOST_STEPS + 1).count() > MOST_STEPS:
        one = lambda d: d.withColumn("__one", F.lit(1))
        got = hot.asof_backward(one(left), one(steps.select(effective, value)), ["__one"], left_ts, effective, [value])
        return got.withColumn(value, F.coalesce(value, F.lit(default))).drop("__one", effective)
    rows = steps.select(effective, value).groupBy().agg(F.sort_array(F.collect_list(F.struct(effective, value))).alias("__steps"))
    past = F.filter("__steps", lambda s: s[effective] <= F.col(left_ts))
    return left.crossJoin(F.broadcast(rows)).withColumn(value, F.coalesce(F.try_element_at(past, F.lit(-1))[value], F.lit(default))).drop("__steps")


def slot_key(day: Column, slot: Column) -> Column:
    """Days of two slots (am 0, pm 1) as one whole number in order of time."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")) * 2 + slot


def time_lag(df: DataFrame, by: list[str], ts: str, value: str, lag: str, name: str) -> DataFrame:
    """The value in force `lag` (an interval) before each row."""
    marked = df.withColumn("__then", F.expr(f"{ts} - INTERVAL {lag}"))
    past = df.select(*by, F.col(ts).alias("__at"), F.col(value).alias(name))
    return asof_join(marked, past, by, "__then", "__at", [name]).drop("__then", "__at")
