"""Simulated policies, event effects and baseline forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.operators.windows import first_hit


def buyer_policy(df: DataFrame, by: list[str], day: str, price: str, discounts: list[float], wait: int) -> DataFrame:
    """Mean saving of waiting up to `wait` rows for each discount against buying at once."""
    d = df
    for i, x in enumerate(discounts):
        d = first_hit(d, by, day, price, F.col(price) * (1 - x), wait, f"__f{i}")
    rows = d.select(*by, F.explode(F.array(*[F.struct(F.lit(x).alias("discount"), (F.col(price) - F.col(f"__f{i}")).alias("saving")) for i, x in enumerate(discounts)])).alias("r"))
    return rows.groupBy(*by, "r.discount").agg(F.count("r.saving").alias("n"), F.avg("r.saving").alias("mean_saving"), F.avg((F.col("r.saving") > 0).cast("double")).alias("share_better"))


def event_move_ratio(df: DataFrame, by: list[str], move: str, near_event: Column) -> DataFrame:
    """Mean absolute move near events over that elsewhere, with the counts."""
    a = F.abs(F.col(move))
    return df.withColumn("__e", near_event).groupBy(*by).agg(F.sum(F.col("__e").cast("int")).alias("n_event"), F.sum((~F.col("__e")).cast("int")).alias("n_other"), F.try_divide(F.avg(F.when(F.col("__e"), a)), F.avg(F.when(~F.col("__e"), a))).alias("ratio"))


def flat_hold(df: DataFrame, by: list[str], order: str, value: str, horizon: int) -> DataFrame:
    """The baseline that is always reported: the last value for every horizon, with its error once known."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("forecast", F.col(value)).withColumn("actual", F.lead(value, horizon).over(w)).withColumn("abs_error", F.abs(F.col("actual") - F.col("forecast")))


def drift_hold(df: DataFrame, by: list[str], order: str, value: str, span: int, horizon: int) -> DataFrame:
    """Last value plus the mean step of the last `span` rows times the horizon."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.try_divide(F.col(value) - F.lag(value, span).over(w), F.lit(span))
    return df.withColumn("forecast", F.col(value) + horizon * step).withColumn("actual", F.lead(value, horizon).over(w))


def premium_carry(df: DataFrame, by: list[str], order: str, value: str, proxy: str, n: int) -> DataFrame:
    """The proxy times the median premium of the n rows before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("__q", F.try_divide(F.col(value), F.col(proxy))).withColumn("forecast", F.col(proxy) * F.percentile("__q", F.lit(0.5)).over(w)).drop("__q")


@udtf(returnType="fold int, train_end int, test_start int, test_end int")
class Folds:
    """Walk-forward folds over n rows: expanding training, an embargo, then a test of `size` rows."""

    def eval(self, n: int, first: int, size: int, embargo: int):
        fold, end = 0, first
        while end + embargo < n:
            yield fold, end, end + embargo, min(n, end + embargo + size)
            fold, end = fold + 1, end + size
