"""Demotion of a model by its trailing folds: error against holding, direction against a floor, range against its nominal share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import student_upper
from tidemark.plans.gates import sticky

FEWEST = 30  # fixed value: a rule is silent on fewer folds


def binomial_lower(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial count, term by term; terms are kept as logarithms, so that many trials do not underflow. 1 for no trials."""
    first = n * math.log(1 - p)
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(a, j):
        log = a["log"] + F.ln((n - j) / (j + 1)) + math.log(p / (1 - p))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n > 0, F.least(F.lit(1.0), F.aggregate(steps, start, step)["sum"])).otherwise(1.0)


def rate_breach(df: DataFrame, by: list[str], order: str, hit: str, window: int, floor: float, alpha: float = 0.05, name: str = "breach") -> DataFrame:
    """Whether the hits of the last `window` rows are too few for a true rate of `floor` (exact, one-sided).

    A row with a null hit (nothing moved) takes a place in the window and counts as no trial.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - window, 0)
    d = df.withColumn("__n", F.count(hit).over(w)).withColumn("__k", F.sum(F.col(hit).cast("int")).over(w))
    d = d.withColumn(f"{name}_p", F.when(F.col("__n") >= FEWEST, binomial_lower(F.col("__k"), F.col("__n"), floor)))
    return d.withColumn(name, F.coalesce(F.col(f"{name}_p") < alpha, F.lit(False))).drop("__n", "__k")


def worse_statistic(df: DataFrame, by: list[str], order: str, difference: str, window: int, lags: int) -> DataFrame:
    """Mean of the last `window` loss differences over its long-run standard error (Bartlett weights), centred before multiplying.

    stat: null on fewer than FEWEST rows or without variance; p_worse: one-sided p of a mean above zero, Student's t with `lags` degrees of
    freedom; without variance (at most 1e-12 of the mean square) 0 for a mean above zero, else 1. mean_difference: the mean.
    """
    last = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - window, 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = df.where(F.col(difference).isNotNull()).withColumn("__l", F.collect_list(F.col(difference).cast("double")).over(last))
    d = d.withColumn("__n", F.size("__l")).withColumn("mean_difference", total(F.col("__l")) / F.col("__n"))
    d = d.withColumn("__c", F.transform("__l", lambda x: x - F.col("mean_difference")))
    n, m, c = F.col("__n"), F.col("mean_difference"), F.col("__c")
    var = total(F.zip_with(c, c, lambda a, b: a * b))
    for k in range(1, lags + 1):
        pairs = F.greatest(n - k, F.lit(0))
        var = var + 2 * (1 - k / (lags + 1)) * total(F.zip_with(F.slice(c, F.lit(k + 1), pairs), F.slice(c, F.lit(1), pairs), lambda a, b: a * b))
    d = d.withColumn("__v", var / n)
    still = F.col("__v") <= 1e-12 * total(F.zip_with("__l", "__l", lambda a, b: a * b)) / n  # all differences alike, but for rounding
    d = d.withColumn("__still", still).withColumn("stat", F.when((n >= FEWEST) & ~F.col("__still"), m / F.sqrt(F.when(F.col("__v") > 0, F.col("__v")) / n)))
    p = F.when(F.col("__still"), F.when(m > 0, 0.0).otherwise(1.0)).otherwise(student_upper(F.col("stat"), lags))
    return d.withColumn("p_worse", F.when(n >= FEWEST, p)).drop("__still", "__l", "__n", "__c", "__v")


def error_breach(df: DataFrame, by: list[str], order: str, difference: str, window: int = 40, lags: int = 4, alpha: float = 0.05) -> DataFrame:
    """Whether the model's loss is above holding's, one-sided at alpha."""
    d = worse_statistic(df, by, order, difference, window, lags)
    return d.withColumn("breach", F.coalesce((F.col("mean_difference") > 0) & (F.col("p_worse") < alpha), F.lit(False)))


def demoted(df: DataFrame, by: list[str], order: str, breach: str = "breach", persist: int = 3) -> DataFrame:
    """Demoted once the last `persist` checks all breach; nothing undoes it."""
    return sticky(df, by, order, breach, persist)
