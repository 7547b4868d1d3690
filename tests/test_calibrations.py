"""Robust walk-forward fits, stale days and the long history against plain versions."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import freshness as S
from tidemark.plans import proxy as P
from tidemark.plans import robust as R

DAY0 = dt.date(2024, 1, 1)


def plain_fit(x, y, w):
    def line(v):
        mx, my = (v * x).sum() / v.sum(), (v * y).sum() / v.sum()
        sxx = (v * (x - mx) ** 2).sum()
        a = (v * (x - mx) * (y - my)).sum() / sxx if sxx > 1e-12 else 0.0
        return a, my - a * mx

    a, b = line(w)
    for _ in range(8):
        r = np.abs(y - a * x - b)
        c = 1.35 * np.median(r) / 0.6744897501960817
        if c <= 0:
            break
        a, b = line(w * np.minimum(1, c / np.maximum(r, 1e-300)))
    return a, b


def plain_quantile(v, w, q):
    turn = np.argsort(v, kind="stable")
    share = np.cumsum(w[turn]) / w.sum()
    return v[turn][min(len(v) - 1, int(np.searchsorted(share, q - 1e-12)))]


def series(n=120, seed=3):
    rng = np.random.default_rng(seed)
    fixes = [(i, float(100 + rng.normal() * 5)) for i in range(n) if i % 7 < 5]
    level = dict(fixes)
    last = None
    readings = []
    for i in range(n):
        last = level.get(i, last)
        if i % 11 != 4:
            readings.append((i, 1.3 * last + 7 + float(rng.normal()) + (40 if i % 17 == 0 else 0)))
    return fixes, readings


def frames(spark, fixes, readings):
    day = lambda i: DAY0 + dt.timedelta(days=i)
    f = spark.createDataFrame([("a", day(i), v) for i, v in fixes], "k string, d date, fix double")
    y = spark.createDataFrame([("a", day(i), v) for i, v in readings], "k string, d date, reading double")
    return y, f


def plain_days(fixes, readings):
    out, fresh, stale = {}, [], []
    for i, y in readings:
        past = [(j, x) for j, x in fixes if j <= i and i - j < 14]
        if not past:
            continue
        j, x = past[-1]
        if len(fresh) >= 30:
            h = np.array(fresh[-200:])
            w = 0.5 ** (np.arange(len(h))[::-1] / 10)
            a, b = plain_fit(h[:, 0], h[:, 1], w)
            hw = plain_quantile(np.abs(h[:, 1] - a * h[:, 0] - b), w, 0.8)
            own = None
            if j < i and len(stale) >= 8:
                s = np.array(stale[-200:])
                own = plain_quantile(np.abs(s[:, 1] - a * s[:, 0] - b), 0.5 ** (np.arange(len(s))[::-1] / 10), 0.8)
            out[i] = (i - j, a * x + b, hw, hw if own is None else own)
        (fresh if i == j else stale).append((x, y))
    return out


def test_scored_days_equal_a_plain_version(spark):
    fixes, readings = series()
    y, f = frames(spark, fixes, readings)
    got = {(r.d - DAY0).days: (r.gap_days, r.estimate, r.half_width, r.half_width_stratified) for r in S.scored_days(y, f, ["k"], "d", "reading", "fix").collect()}
    want = plain_days(fixes, readings)
    assert set(got) == set(want) and len(want) > 50
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-8)
    assert any(g[0] > 0 and g[2] != g[3] for g in got.values())


def test_no_day_sees_later_rows(spark):
    """Rows of the day itself and after do not move a day's estimate, bands or strategies (but for the reading scored)."""
    fixes, readings = series()
    cut = 90
    later = [(i, v + (500 if i >= cut else 0)) for i, v in readings], [(i, v - (300 if i > cut else 0)) for i, v in fixes]
    seen = []
    for r, f in ((readings, fixes), later):
        y, x = frames(spark, f, r)
        bench = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), 100.0 + i % 3) for i in range(120)], "k string, d date, bench double")
        d = S.stale_day_strategies(S.scored_days(y, x, ["k"], "d", "reading", "fix").join(bench, ["k", "d"], "left"), ["k"], "d", "reading", "bench")
        d = d.where(F.col("d") <= DAY0 + dt.timedelta(days=cut)).drop("reading")
        seen.append(sorted(map(str, d.collect())))
    assert seen[0] == seen[1] and len(seen[0]) > 20


def test_strategies_fall_back(spark):
    """A reading older than four days is not carried; without enough errors the band is the one before; without a benchmark s3 is not tried."""
    fixes, readings = series()
    y, f = frames(spark, fixes, [(i, v) for i, v in readings if not 60 <= i < 68])
    days = S.scored_days(y, f, ["k"], "d", "reading", "fix").withColumn("bench", F.when(F.dayofmonth("d") > 15, F.lit(100.0)))
    rows = S.stale_day_strategies(days, ["k"], "d", "reading", "bench").collect()
    for r in rows:
        if r.gap_days == 0:
            assert r.s2_estimate == r.s1_estimate and r.s2_half_width == r.s1_half_width and r.s3_estimate is None
        elif (r.d - r.previous_day).days > 4:
            assert r.s2_estimate_fallback and r.s2_estimate == r.s1_estimate
        else:
            assert r.s2_estimate == r.previous
        assert (r.s3_estimate is None) == (r.bench is None or r.gap_days == 0)
        if r.s3_estimate_fallback:
            assert r.s3_estimate == r.s2_estimate
    assert {r.s3_estimate_fallback for r in rows} >= {True, None}


def test_coverage_of_no_days(spark):
    y, f = frames(spark, [], [])
    assert S.coverage(S.scored_days(y, f, ["k"], "d", "reading", "fix"), ["k"], "reading").count() == 0


def test_fits_of_short_and_flat_histories(spark):
    schema = "i int, p array<struct<x:double,y:double>>"
    d = spark.createDataFrame([(0, None), (1, []), (2, [(1.0, 5.0)]), (3, [(2.0, 3.0)] * 4), (4, [(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)])], schema)
    d = d.withColumn("fit", R.huber_fit(F.col("p"))).withColumn("w", R.residual_quantile(F.col("p"), F.col("fit"), 0.8))
    got = {r.i: (r.fit.slope, r.fit.intercept, r.w) for r in d.collect()}
    assert got[0] == got[1] == (None, None, None)
    assert got[2] == (0.0, 5.0, 0.0) and got[3] == pytest.approx((0.0, 3.0, 0.0))
    assert got[4] == pytest.approx((2.0, 1.0, 0.0), abs=1e-9)


def roll_rows(n=90, jump=60, size=1.25):
    rng = np.random.default_rng(5)
    ref = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    own = ref * np.exp(rng.normal(0, 0.0005, n))
    own[jump:] *= size
    return ref, own


def test_a_roll_is_taken_out(spark):
    ref, own = roll_rows()
    d = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), float(o), float(r)) for i, (o, r) in enumerate(zip(own, ref))], "k string, d date, v double, ref double")
    rows = P.adjust_rolls(d, ["k"], "d", "v", "ref").orderBy("d").collect()
    assert [i for i, r in enumerate(rows) if r.roll] == [60]
    assert all(abs(math.log(r.adjusted / r.ref)) < 0.01 for r in rows)


def test_long_history(spark):
    """Day t uses the drivers of t - 1; the duty steps in on its day; the young series starts late and is met; without it the raw value stays."""
    ref, own = roll_rows()
    day = lambda i: DAY0 + dt.timedelta(days=i)
    drivers = spark.createDataFrame([(k, day(i), float(o), float(r), 2.0) for k in "ab" for i, (o, r) in enumerate(zip(own, ref))], "k string, d date, fut double, ref double, fx double")
    steps = spark.createDataFrame([(day(50), 10.0)], "effective date, pct double")
    adjusted = {i: r.adjusted for i, r in enumerate(P.adjust_rolls(drivers.where("k = 'a'"), ["k"], "d", "fut", "ref").orderBy("d").collect())}
    young = spark.createDataFrame([("a", day(i), 3 * adjusted[i - 1] * 2.0 * (1.1 if i >= 50 else 1.04) + 11) for i in range(30, 90)], "k string, d date, y double")
    rows = P.long_history(drivers, young, steps, ["k"], "d", "fut", "ref", "fx", "y").orderBy("k", "d").collect()
    a, b = rows[:90], rows[90:]
    assert a[0].raw_pre_duty is None and a[10].raw_pre_duty == pytest.approx(2 * adjusted[9])
    assert [a[i].duty_pct for i in (49, 50)] == [4.0, 10.0] and a[61].roll_adjusted and not a[60].roll_adjusted
    assert [r.is_oos for r in a] == [i >= 60 for i in range(90)] and not any(r.is_oos for r in b)
    assert all(r.proxy == pytest.approx(3 * r.raw_with_duty + 11) for r in a[1:])
    assert all(r.proxy == r.raw_with_duty for r in b)
