"""Embargoed walk-forward evaluation of a classifier that is fitted anew for every fold.

Fold i is fitted on the rows whose label had matured strictly before its decision day, and on no other. The classifier is a linear discriminant with
a variance for each feature: its fit is class counts, sums and sums of squares, so all folds are running sums over one timeline of labels and
decisions, one sort for each key, whatever the number of folds. A null feature is left out of the sums and says nothing in a prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.demotion import binomial_lower
from tidemark.plans.walkforward import matured_sums

TINY = 1e-12


def fold_predictions(df: DataFrame, by: list[str], decision: str, label_day: str, features: list[str], y: str, least: int = 30) -> DataFrame:
    """Rows that have a label and at least `least` labelled rows before them, with n_train, p (null for a skipped fold) and persistence, the latest known label.

    A fold is skipped if fewer than `least` labels have matured, or only one class. Rows of equal decision day are folds of the same training rows.
    """
    one = F.col(y).cast("double")
    d = df.where(F.col(y).isNotNull())
    sums = {"__n1": one, "__n": F.lit(1.0)}
    for i, f in enumerate(features):
        for c, mine in (("0", 1 - one), ("1", one)):
            x = F.when(F.col(f).isNotNull(), F.col(f).cast("double"))
            sums |= {f"__m{i}{c}": F.when(x.isNotNull(), mine), f"__s{i}{c}": mine * x, f"__q{i}{c}": mine * x * x}
    d = matured_sums(d, by, decision, label_day, sums, latest={"persistence": one})
    n, n1 = F.col("__n"), F.col("__n1")
    ok = (n >= least) & (n1 > 0) & (n1 < n)
    logit = F.ln(F.when(ok, n1 / (n - n1)))
    for i, f in enumerate(features):
        m0, m1, s0, s1, q0, q1 = (F.col(f"__{k}{i}{c}") for k in "msq" for c in "01")
        both = (m0 > 0) & (m1 > 0)
        a, b = s0 / F.when(both, m0), s1 / F.when(both, m1)
        var = (q0 - m0 * a * a + q1 - m1 * b * b) / (m0 + m1)
        x = F.col(f).cast("double")
        says = ((x - a) * (x - a) - (x - b) * (x - b)) / (2 * F.when(var > TINY, var))
        logit = logit + F.coalesce(says, F.lit(0.0))
    d = d.withColumn("p", F.when(ok, 1 / (1 + F.exp(-logit)))).withColumn("n_train", n.cast("long")).withColumn("persistence", F.when(ok, F.col("persistence")))
    d = d.select(*df.columns, "n_train", "p", "persistence")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(decision))  # above p, so that p is worked out once however often it is read
    return d.withColumn("__i", nth).where(F.col("__i") > least).drop("__i")


def fold_scores(folds: DataFrame, by: list[str], y: str, bins: int = 10) -> DataFrame:
    """For each key: folds and skipped ones, accuracy, Brier score, log loss and calibration error of p and of persistence, the share of the larger call
    ("always up"), the folds on which the two disagree about being right, and the exact two-sided p of that disagreement."""
    clip = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-15)), F.lit(1e-15))
    d = folds.withColumn("__y", F.col(y).cast("double"))
    good = F.col("p").isNotNull()
    out = [F.count(F.when(good, 1)).alias("n_folds"), F.count(F.when(~good, 1)).alias("n_skipped"), F.avg(F.when(good, F.col("__y"))).alias("always_up_accuracy")]
    right = {c: (F.col(c) >= 0.5) == (F.col("__y") == 1) for c in ("p", "persistence")}
    for c, name in (("p", "model"), ("persistence", "persistence")):
        q = clip(F.col(c))
        out += [F.avg(F.when(good, right[c].cast("double"))).alias(f"{name}_accuracy"), F.avg(F.when(good, (F.col(c) - F.col("__y")) * (F.col(c) - F.col("__y")))).alias(f"{name}_brier"), F.avg(F.when(good, -F.when(F.col("__y") == 1, F.ln(q)).otherwise(F.ln(1 - q)))).alias(f"{name}_log_loss")]
    out += [F.count(F.when(good & right["p"] & ~right["persistence"], 1)).alias("__b"), F.count(F.when(good & ~right["p"] & right["persistence"], 1)).alias("__c")]
    g = d.groupBy(*by).agg(*out)
    bucket = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    cells = d.where(good).groupBy(*by, bucket.alias("__bin")).agg(F.count(F.lit(1)).alias("__m"), F.abs(F.avg("p") - F.avg("__y")).alias("__gap"))
    ece = cells.groupBy(*by).agg((F.sum(F.col("__m") * F.col("__gap")) / F.sum("__m")).alias("model_ece"))
    g = g.withColumn("n_discordant", F.col("__b") + F.col("__c")).withColumn("p_value", F.least(F.lit(1.0), 2 * binomial_lower(F.least("__b", "__c"), F.col("n_discordant"), 0.5)))
    return g.join(ece, by, "left").drop("__b", "__c")
