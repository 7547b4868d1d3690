"""Data-quality rules, leak guard and ordered exclusions: each is a Column or one pass over the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFO, WARN, BLOCK = 0, 1, 2
PIECE_MB = 2  # of the optimizer's estimate, which for parquet is the columns' share of the compressed file
SEVERITY = ["info", "warn", "block"]


def violations(df: DataFrame, key: list[str], rules: list[tuple[str, int, Column]]) -> DataFrame:
    """One row for each row and broken rule: key, code, severity. A rule whose condition is null does not fire."""
    fired = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("code"), F.lit(s).alias("severity"))) for k, s, c in rules]))
    return df.select(*key, F.explode(fired).alias("v")).select(*key, "v.code", "v.severity")


def summary(v: DataFrame) -> DataFrame:
    return v.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"))


def worst(v: DataFrame) -> DataFrame:
    """Roll-up: worst severity as a word, and how many of each."""
    w = F.coalesce(F.max("severity"), F.lit(-1))
    name = F.when(w < 0, "ok")
    for i, s in enumerate(SEVERITY):
        name = name.when(w == i, s)
    return v.agg(name.alias("status"), *[F.sum((F.col("severity") == i).cast("int")).alias(f"n_{s}") for i, s in enumerate(SEVERITY)])


def top_violations(v: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """The worst `most` violations and how many were left out."""
    shown = v.orderBy(F.col("severity").desc(), *order).limit(most)
    total = v.agg(F.count(F.lit(1)).alias("__t"))
    return shown.crossJoin(F.broadcast(total)).withColumn("truncated", F.greatest(F.lit(0), F.col("__t") - most)).drop("__t")


def timestamp_rules(ts: str, now: Column, previous: Column | None = None, slack_minutes: int = 5, least_year: int = 2000) -> list:
    t = F.col(ts).cast("timestamp")
    rules = [("ts_missing", BLOCK, F.col(ts).isNull()), ("ts_epoch", BLOCK, F.year(t) < least_year), ("ts_future", BLOCK, t > now + F.expr(f"INTERVAL {slack_minutes} MINUTES"))]
    return rules + ([("ts_not_after_previous", BLOCK, t <= previous.cast("timestamp"))] if previous is not None else [])


def number_rules(c: str, low: float, high: float, warn_low: float | None = None, warn_high: float | None = None, typical: Column | None = None) -> list:
    x = F.col(c).cast("double")
    rules = [("num_missing", BLOCK, F.col(c).isNull()), ("num_not_finite", BLOCK, F.isnan(x) | (F.abs(x) == float("inf"))), ("num_not_positive", BLOCK, x <= 0), ("num_out_of_bounds", BLOCK, (x > 0) & ((x < low) | (x > high)))]
    if warn_low is not None:
        rules.append(("num_unusual", WARN, (x >= low) & (x <= high) & ((x < warn_low) | (x > warn_high))))
    if typical is not None:
        r = x / typical
        rules.append(("num_unit_suspect", WARN, r.between(9, 11) | r.between(0.09, 0.11)))
    return rules


def jump_rules(value: str, previous: Column, gap_days: Column, scale: float) -> list:
    """Absolute log move over the root of the gap, against 2 and 4 times the usual extreme."""
    m = F.when((F.col(value) > 0) & (previous > 0) & (gap_days > 0), F.abs(F.ln(F.col(value) / previous)) / F.sqrt(gap_days))
    return [("jump_warn", WARN, (m > 2 * scale) & (m <= 4 * scale)), ("jump_block", BLOCK, m > 4 * scale)]


def ratio_rule(code: str, a: str, b: str, low: float, high: float, severity: int = BLOCK) -> tuple:
    return code, severity, ~(F.col(a) / F.when(F.col(b) != 0, F.col(b))).between(low, high)


def stale_rules(age: Column, warn: float, block: float) -> list:
    return [("stale_warn", WARN, (age >= warn) & (age < block)), ("stale_block", BLOCK, age >= block)]


def source_spread(df: DataFrame, moment: list[str], value: str, most: float) -> DataFrame:
    """Moments at which sources differ by more than `most` of their mean, to nine decimals: sums of doubles have no order. A mean of zero has no spread."""
    mean = F.avg(value)
    d = df.groupBy(*moment).agg(F.count(value).alias("n"), F.round((F.max(value) - F.min(value)) / F.when(mean != 0, mean), 9).alias("spread"))
    return d.where((F.col("n") > 1) & (F.col("spread") > most))


def leaks(df: DataFrame, key: list[str], prediction: str, inputs: list[str]) -> DataFrame:
    """Rows with an input whose known-at is not strictly before the prediction: equality is a leak, an unknown moment too."""
    bad = F.filter(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("timestamp").alias("known_at")) for c in inputs]), lambda s: s["known_at"].isNull() | (s["known_at"] >= F.col(prediction).cast("timestamp")))
    return df.select(*key, F.col(prediction), F.explode(bad).alias("b")).select(*key, prediction, "b.input", "b.known_at")


def refuse_leaks(df: DataFrame, prediction: str, inputs: list[str]) -> DataFrame:
    """The same rows; the query fails if one leaks."""
    ok = None
    for c in inputs:
        one = F.coalesce(F.col(c).cast("timestamp") < F.col(prediction).cast("timestamp"), F.lit(False))
        ok = one if ok is None else ok & one
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("an input was not known before the prediction")).cast("boolean")))


def excluded(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """With the first rule that excludes each row (null: none), in the order given."""
    why = None
    for name, cond in rules:
        why = F.when(cond, name) if why is None else why.when(cond, name)
    return df.withColumn("excl_reason", why)


def pieces(df: DataFrame) -> int:
    """How many pieces of about PIECE_MB the optimizer's estimate of df's size makes; no job is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, min(1 << 16, math.ceil(size / (PIECE_MB * 1e6))))


def integrity(df: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Per key: rows, repeated times, out-of-order arrivals cannot be seen in a table; missing and non-positive values.

    Moments hardly repeat, so rows are dealt by key and moment to a number of tasks that grows with the input before they are added up:
    a task's groups are those of PIECE_MB of input, whatever its size, and a key with very many rows is spread.
    """
    used = df.select(*by, ts, value)
    d = used.repartition(pieces(used), *by, ts).groupBy(*by, ts).agg(F.count(F.lit(1)).alias("__n"), F.sum((~(F.col(value) > 0) | F.col(value).isNull()).cast("int")).alias("__b"))
    return d.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum((F.col("__n") > 1).cast("int")).alias("repeated_times"), F.sum("__b").alias("bad_values"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def previous(by: list[str], order: str, c: str) -> Column:
    return F.lag(c).over(Window.partitionBy(*by).orderBy(order))
