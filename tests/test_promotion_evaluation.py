"""Bounds, comparisons and fitted folds against plain loops; the leak test of the evaluator."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import evaluation as E
from tidemark.plans import promotion as P
from tidemark.plans.demotion import binomial_lower

D0 = dt.date(2024, 1, 1)


def long_run(e, lags):
    n, c = len(e), np.array(e) - np.mean(e)
    return max(0.0, (c @ c + 2 * sum((1 - g / (lags + 1)) * (c[g:] @ c[:-g]) for g in range(1, min(lags, n - 1) + 1))) / n)


def distance(n, level, sd):
    a = n + 1 / sd**2
    f = lambda s: math.log(2 / sd) - 0.5 * math.log(a) + s * s / (2 * a) + math.log(0.5 * math.erfc(-s / math.sqrt(2 * a))) - math.log(1 / level)
    lo, hi = 0.0, 60 * math.sqrt(a)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def test_distance_equals_bisection(spark):
    for level, sd in ((0.05 / 3, 0.3), (0.001, 1.0), (0.2, 0.05)):
        got = spark.range(1, 3000, 97).select("id", P.mixture_distance(F.col("id").cast("double"), level, sd).alias("s")).collect()
        assert all(r["s"] == pytest.approx(distance(r["id"], level, sd), rel=1e-10) for r in got)


def test_bounds_equal_the_formula_after_every_row(spark):
    rng = random.Random(3)
    series = {1: [rng.gauss(0.4, 1) for _ in range(70)], 2: [2.0] * 40, 3: [1.0], 4: [rng.gauss(0, 1) + (i % 7) for i in range(45)]}
    rows = [(k, D0 + dt.timedelta(i), v) for k, x in series.items() for i, v in enumerate(x)] + [(1, D0 + dt.timedelta(500), None)]
    for floor in (True, False):
        got = {(r["k"], r["n"]): r for r in P.anytime_lower(spark.createDataFrame(rows, "k int, d date, e double"), ["k"], "d", "e", 0.05 / 3, 4, 0.3, 20, 1.5, floor).collect()}
        assert len(got) == sum(map(len, series.values()))
        for k, x in series.items():
            for n in range(1, len(x) + 1):
                var = long_run(x[:n], 4) if n > 1 else 0.0
                var = max(var, np.var(x[:n])) if floor else var
                want = np.mean(x[:n]) - math.sqrt(1.5 * var) * distance(n, 0.05 / 3, 0.3) / n if n >= 20 and var > 1e-15 else None
                assert got[k, n]["lower"] == (pytest.approx(want, abs=1e-9) if want is not None else None)


def comparison_rows():
    rng, rows = random.Random(9), []
    for i in range(120):
        d, la = D0 + dt.timedelta(i), 10 + rng.random()
        rows += [(1, d, "good", la, la * 0.5 + rng.random(), 1, i % 3 > 0, True), (1, d, "better", la, la * 0.4 + rng.random() if i % 2 else None, 1, 1, True), (1, d, "wild", la, la * 0.3 + rng.random(), 1, 1, i % 2 == 0)]
        rows += [(1, d, "young", la, la * 0.1 if i > 118 else None, 1, 1, True)]
    rows += [(2, D0 + dt.timedelta(i), "good", 5.0, 5.0 * (0.4 + 0.01 * (i % 5)), 1, 1, True) for i in range(250)]
    return [(k, d, c, la, lb, int(ha), int(hb), cov) for k, d, c, la, lb, ha, hb, cov in rows]


def test_comparison_and_promotion(spark):
    kind = "k int, d date, c string, la double, lb double, ha int, hb int, cov boolean"
    df = spark.createDataFrame(comparison_rows(), kind)
    args = dict(loss_a="la", loss_b="lb", hit_a="ha", hit_b="hb", covered="cov")
    got = {(r["k"], r["c"]): r for r in P.promoted(P.compared(df, ["k"], "c", "d", **args), ["k"], "c", ["good", "better", "wild", "young"]).collect()}
    good, better, wild, young, old = (got[x] for x in ((1, "good"), (1, "better"), (1, "wild"), (1, "young"), (2, "good")))
    assert young["status"] == "too early" and young["n"] == 1 and not young["promotable"] and young["gain"] is None
    assert better["n"] == 60 and better["days_since_registration"] == 118 and better["promotable"] and better["promoted"]
    assert not good["direction_ok"] and good["lower_bound_clears"] and not good["promotable"]
    assert not wild["coverage_ok"] and wild["coverage_p_below"] < 1e-6 and not wild["promoted"]
    assert old["retired"] and old["horizon_left"] == 0 and not old["promotable"]
    blocked = {r["c"]: r for r in P.promoted(P.compared(df.where("k = 1"), ["k"], "c", "d", **args), ["k"], "c", ["better"], {"better": "held"}).collect()}
    assert blocked["better"]["blocked_reason"] == "held" and not any(r["promoted"] for r in blocked.values())
    e = [0.95 * la - lb for k, d, c, la, lb, *_ in comparison_rows() if k == 1 and c == "better" and lb is not None]
    la = [r[3] for r in comparison_rows() if r[0] == 1 and r[2] == "better" and r[4] is not None]
    lower = np.mean(e) - math.sqrt(1.5 * max(long_run(e, 4), np.var(e))) * distance(60, 0.05 / 3, 0.3) / 60
    assert better["lower_bound"] == pytest.approx(0.05 + lower / np.mean(la), rel=1e-9)


def test_binomial_tail_of_many_trials(spark):
    for k, n, p in ((0, 40, 0.3), (1500, 2000, 0.8), (990, 2000, 0.5), (5, 5, 0.2)):
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        assert spark.range(1).select(binomial_lower(F.lit(k), F.lit(n), p)).first()[0] == pytest.approx(min(1.0, want), rel=1e-8)


def fold_rows(seed=5, n=130):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 2)
        y = None if i % 17 == 5 else int(a + 0.3 * b + rng.gauss(0, 0.5) > 0)
        rows.append((1, D0 + dt.timedelta(i), D0 + dt.timedelta(i + 1 + i % 4), a, None if i % 5 == 0 else b, y))
    return rows + [(2, D0 + dt.timedelta(i), D0 + dt.timedelta(i + 2), 0.5, 1.0, 1) for i in range(50)]


def plain_fold(rows, i, least):
    """(number of training rows, p, latest known label) of one fold, from its training rows alone."""
    k, d = rows[i][:2]
    train = sorted((r for r in rows if r[0] == k and r[5] is not None and r[2] < d), key=lambda r: r[1])
    ys = [r[5] for r in train]
    if len(train) < least or len(set(ys)) < 2:
        return len(train), None, None
    logit = math.log(sum(ys) / (len(ys) - sum(ys)))
    for f in (3, 4):
        x0, x1 = ([r[f] for r in train if r[f] is not None and r[5] == y] for y in (0, 1))
        if x0 and x1 and rows[i][f] is not None:
            var = (sum((v - np.mean(x0)) ** 2 for v in x0) + sum((v - np.mean(x1)) ** 2 for v in x1)) / (len(x0) + len(x1))
            if var > 1e-12:
                logit += ((rows[i][f] - np.mean(x0)) ** 2 - (rows[i][f] - np.mean(x1)) ** 2) / (2 * var)
    return len(train), 1 / (1 + math.exp(-logit)), float(ys[-1])


KIND = "k int, d date, ld date, a double, b double, y int"


def predictions(spark, rows, least=30):
    return {(r["k"], r["d"]): (r["n_train"], r["p"], r["persistence"]) for r in E.fold_predictions(spark.createDataFrame(rows, KIND), ["k"], "d", "ld", ["a", "b"], "y", least).collect()}


def test_folds_equal_fits_on_their_own_rows(spark):
    rows = fold_rows()
    got = predictions(spark, rows)
    labelled = {k: [i for i, r in enumerate(rows) if r[0] == k and r[5] is not None] for k in (1, 2)}
    assert set(got) == {rows[i][:2] for k in labelled for i in labelled[k][30:]}
    for i, r in enumerate(rows):
        if r[:2] in got:
            n, p, prev = plain_fold(rows, i, 30)
            assert got[r[:2]] == (n, p if p is None else pytest.approx(p, abs=1e-9), prev)
    s = {r["k"]: r for r in E.fold_scores(E.fold_predictions(spark.createDataFrame(rows, KIND), ["k"], "d", "ld", ["a", "b"], "y"), ["k"], "y").collect()}
    assert s[2]["n_folds"] == 0 and s[2]["n_skipped"] == 20 and s[1]["model_accuracy"] > s[1]["persistence_accuracy"] + 0.1 and s[1]["n_folds"] + s[1]["n_skipped"] == len(labelled[1]) - 30


def test_labels_that_are_not_known_yet_change_nothing(spark):
    rows = fold_rows()
    at = D0 + dt.timedelta(90)
    turned = [(k, d, ld, a, b, y if y is None or ld < at else 1 - y) for k, d, ld, a, b, y in rows]
    before, after = predictions(spark, rows), predictions(spark, turned)
    seen = [x for x in before if x[0] == 1 and x[1] <= at]
    assert len(seen) > 40 and all(before[x] == after[x] for x in seen)
    assert any(before[x] != after[x] for x in before if x[1] > at + dt.timedelta(10))
