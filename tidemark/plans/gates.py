"""Decision gates: each gives a flag and the first reason against, as Columns over one row of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failure(*checks: tuple[str, Column]) -> tuple[Column, Column]:
    """(passes, reason): checks are (reason, condition that must hold); an unknown condition fails."""
    why = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        why = F.when(F.coalesce(ok, F.lit(False)), why).otherwise(F.lit(name))
    return why.isNull(), why


def direction_gate(n="n", significant="significant", brier="brier", base_brier="base_brier", accuracy="accuracy", base_accuracy="base_accuracy", ece="ece", least: int = 30, most_ece: float = 0.10):
    """A direction probability may be shown."""
    c = F.col
    return first_failure(("missing metrics", c(n).isNotNull() & c(brier).isNotNull() & c(accuracy).isNotNull() & c(ece).isNotNull()), ("too few folds", c(n) >= least), ("not significant", c(significant)), ("brier not better", c(brier) < c(base_brier)), ("accuracy not better", c(accuracy) > c(base_accuracy)), ("not calibrated", c(ece) <= most_ece))


def timing_gate(direction_ok: Column, n="n", edge="edge", ece="ece", p="p"):
    c = F.col
    return first_failure(("direction gate", direction_ok), ("too few folds", c(n) >= 60), ("edge too small", c(edge) >= 0.05), ("not calibrated", c(ece) <= 0.05), ("not significant", c(p) < 0.01))


def promotion_gate(forward_days: Column, bound: Column, coverage_ok: Column, direction_ok: Column, live: Column, blocked: Column, age_days: Column):
    """A challenger may replace the champion."""
    return first_failure(("not live-capable", live), ("blocked", ~blocked), ("retired", age_days <= 180), ("too few forward days", forward_days >= 20), ("bound not above zero", bound > 0), ("coverage worse", coverage_ok), ("direction worse", direction_ok))


def experiment_gate(gain: Column, p: Column, folds: Column, subset_gain: Column | None = None):
    checks = [("gain below 2 %", gain >= 0.02), ("not significant", p < 0.05), ("too few folds", folds >= 30)]
    return first_failure(*checks, *([("subset inverted", subset_gain >= 0)] if subset_gain is not None else []))


def event_gate(p_bonferroni: Column, ratio: Column):
    return first_failure(("not significant", p_bonferroni < 0.05), ("effect below 1.2", ratio >= 1.2))


def cell_gate(bonferroni: Column, bh: Column, n: Column, effective: Column, effect: Column, floor: float, least: int = 20):
    return first_failure(("bonferroni", bonferroni), ("benjamini-hochberg", bh), ("too few signals", n >= least), ("effective n", effective >= least), ("below floor", F.abs(effect) >= floor))


def live_gate(n: Column, lower: Column, least: int = 10):
    return first_failure(("first look not reached", n >= least), ("bound not above zero", lower > 0))


def coverage_alert(e_value: Column, threshold: float = 20.0) -> Column:
    return F.coalesce(e_value >= threshold, F.lit(False))


def human_record(record: Column):
    return first_failure(("no promotion record", record.isNotNull() & record))


def simplest_good(df: DataFrame, by: list[str], complexity: str, error: str, slack: float = 0.01) -> DataFrame:
    """The simplest model whose error is within `slack` of the best one."""
    best = F.min(error).over(Window.partitionBy(*by))
    d = df.withColumn("__ok", F.col(error) <= best * (1 + slack))
    w = Window.partitionBy(*by).orderBy(complexity, error)
    return d.where("__ok").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__ok", "__r")


def refit_due(new_pairs: Column, least: int = 10) -> Column:
    return F.coalesce(new_pairs >= least, F.lit(False))


def sticky(df: DataFrame, by: list[str], order: str, breach: str, checks: int = 3) -> DataFrame:
    """Demoted once the last `checks` checks all breach; nothing but a person undoes it, so it stays so."""
    w = Window.partitionBy(*by).orderBy(order)
    last = w.rowsBetween(-(checks - 1), 0)
    b = F.coalesce(F.col(breach), F.lit(False)).cast("int")
    d = df.withColumn("__b", b)
    full = F.count("__b").over(last) == checks
    d = d.withColumn("__t", (full & (F.min("__b").over(last) == 1)).cast("int"))
    return d.withColumn("demoted", F.max("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__b", "__t")
