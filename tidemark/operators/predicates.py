"""Filters and row predicates with time semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in the columns."""
    return df.na.drop(subset=columns)


def last_complete(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each key's last row, if it is complete: an incomplete last row gives none, not an older one."""
    last = df.groupBy(*by).agg(F.max_by(F.struct(*df.columns), order).alias("__r")).select("__r.*")
    return last.na.drop(subset=columns)


def trailing(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Rows within `days` before now, inclusive. `now` is always given, never the clock."""
    return df.where((F.col(ts).cast("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts).cast("timestamp") <= now))


def trailing_newest(df: DataFrame, ts: str, days: int) -> DataFrame:
    """The same anchored on the newest row."""
    newest = df.agg(F.max(F.col(ts).cast("timestamp")).alias("__now"))
    return df.crossJoin(F.broadcast(newest)).where(F.col(ts).cast("timestamp") >= F.col("__now") - F.expr(f"INTERVAL {days} DAYS")).drop("__now")


def sub_period(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """start <= day < end."""
    return df.where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date")))


def genuine(by: list[str], order: str, value: str, filled: str | None = None) -> Column:
    """An observation of its own: not filled in and different from the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    own = F.coalesce(F.col(value) != F.lag(value).over(w), F.col(value).isNotNull())
    return own & ~F.col(filled) if filled else own


def weekend_carry(by: list[str], day: str, value: str) -> Column:
    """A weekend row that repeats the row before."""
    w = Window.partitionBy(*by).orderBy(day)
    return F.coalesce((F.weekday(day) >= 5) & (F.col(value) == F.lag(value).over(w)), F.lit(False))


def live_only(retro: str, strict: bool = True) -> Column:
    """strict: only an explicit false is live; else everything but an explicit true."""
    return F.col(retro).eqNullSafe(F.lit(False)) if strict else ~F.col(retro).eqNullSafe(F.lit(True))


def valid_fold(*columns: str) -> Column:
    """All finite and above zero."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & F.coalesce((x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))
    return ok


def every_kth(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__i", F.row_number().over(w)).where((F.col("__i") - 1) % k == 0).drop("__i")


def must_be_positive(df: DataFrame, c: str) -> DataFrame:
    """The same rows; the query fails on a value that is not above zero."""
    return df.where(F.when(F.coalesce(F.col(c) > 0, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"{c} must be above zero")).cast("boolean")))


def chart_series(df: DataFrame, by: list[str], order: str, raw: str, derived: str, least: int = 2) -> DataFrame:
    """The derived series where a key has at least `least` values of it, else the kind of the key's latest row."""
    n = df.groupBy(*by).agg(F.count(derived).alias("__n"), F.max_by(F.col(derived).isNotNull(), order).alias("__d"))
    use = (F.col("__n") >= least) | F.col("__d")
    return df.join(n, by).withColumn("shown", F.when(use, F.col(derived)).otherwise(F.col(raw))).drop("__n", "__d")
