"""Traps of the temporal semantics, on small tables."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import stats as T
from tidemark.operators import aggregates as A
from tidemark.operators import asof as J
from tidemark.operators import joins as R
from tidemark.operators import quality as Q
from tidemark.operators import windows as W
from tidemark.plans import gates as G
from tidemark.plans import models as M
from tidemark.plans import walkforward as P
from tidemark.sources import readers, stores
from tidemark.streaming import alerts as ST


def day(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def two(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 3, 3), ("c", 1, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 9, None), ("b", 4, 7.0)], "k string, u int, v double")
    return left, right


@pytest.mark.parametrize("direction, exact, expected", [("backward", True, {1: 50.0, 2: None, 3: None, 4: None}), ("backward", False, {1: None, 2: None, 3: None, 4: None}), ("forward", True, {1: 50.0, 2: None, 3: 7.0, 4: None}), ("forward", False, {1: None, 2: None, 3: 7.0, 4: None})])
def test_asof_ties(two, direction, exact, expected):
    got = J.asof_join(*two, ["k"], "t", "u", ["v"], direction, exact)
    assert {r["id"]: r["v"] for r in got.collect()} == expected


def test_asof_null_value_is_a_match(two):
    got = {r["id"]: r["u"] for r in J.asof_join(*two, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: 5, 2: 9, 3: None, 4: None}


def test_asof_empty_right(two):
    left, right = two
    assert {r["v"] for r in J.asof_join(left, right.limit(0), ["k"], "t", "u", ["v"]).collect()} == {None}


def test_schedule_before_first_step(spark):
    left = spark.createDataFrame([(1, day("2020-01-01")), (2, day("2020-06-01"))], "id int, d date")
    steps = spark.createDataFrame([(day("2020-03-01"), 5.0)], "eff date, pct double")
    assert {r["id"]: r["pct"] for r in J.step_schedule(left, steps, "d", "eff", "pct", 9.0).collect()} == {1: 9.0, 2: 5.0}


def test_seven_days_are_open_on_the_left(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0), ("a", dt.datetime(2024, 1, 8), 3.0)], "k string, ts timestamp, v double")
    assert [r["r_n"] for r in W.rolling(df, ["k"], "ts", "v", 7).orderBy("ts").collect()] == [1, 1]


@pytest.mark.parametrize("gap, segments", [(3, 1), (4, 1), (5, 2)])
def test_gap_segments(spark, gap, segments):
    d = day("2024-01-05")
    df = spark.createDataFrame([("a", d), ("a", d + dt.timedelta(gap))], "k string, d date")
    assert W.gap_segments(df, ["k"], "d", 4).select("segment").distinct().count() == segments


def test_rows_since_counts_from_one_before_the_first(spark):
    df = spark.createDataFrame([("a", i, e) for i, e in enumerate([False, False, True, False])], "k string, i int, e boolean")
    assert [r["n"] for r in W.rows_since(df, ["k"], "i", F.col("e"), "n").orderBy("i").collect()] == [1, 2, 0, 1]


def test_weighted_percentile_is_a_step(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 2.0)], "k string, v double, w double")
    assert A.weighted_percentile(df, ["k"], "v", "w", 0.5).first()["weighted_percentile"] == 2.0


def test_last_row_and_last_known_value(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None)], "k string, t int, v double")
    assert A.last_per_group(df, ["k"], ["t"], ["v"]).first()["v"] is None
    assert A.last_known_per_group(df, ["k"], ["t"], ["v"]).first()["v"] == 5.0


def test_weekdays(spark):
    days = [(day("2024-01-05") + dt.timedelta(i), day("2024-01-05") + dt.timedelta(j)) for i in range(9) for j in range(i, 20)]
    got = spark.createDataFrame(days, "a date, b date").select("a", "b", S.weekdays_from("a", "b").alias("n"), S.business_days_since("a", "b").alias("m")).collect()
    for r in got:
        n = (r["b"] - r["a"]).days
        assert r["n"] == sum((r["a"] + dt.timedelta(i)).weekday() < 5 for i in range(n))
        assert r["m"] == sum((r["a"] + dt.timedelta(i + 1)).weekday() < 5 for i in range(n))


def test_local_moment_knows_summer_time(spark):
    df = spark.createDataFrame([(day("2024-07-01"),), (day("2024-01-02"),)], "d date")
    got = [str(r[0]) for r in df.select(S.local_moment("d", "13:30", "America/New_York")).collect()]
    assert got == ["2024-07-01 17:30:00", "2024-01-02 18:30:00"]


def test_sanitising(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r["v"] for r in readers.sanitised(df, ["v"]).collect()] == [1.0] + [None] * 5


def test_leak_equality(spark):
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, t, t), (2, t, t - dt.timedelta(seconds=1)), (3, t, None)], "id int, p timestamp, k timestamp")
    assert {r["id"] for r in Q.leaks(df, ["id"], "p", ["k"]).collect()} == {1, 3}
    with pytest.raises(Exception):
        Q.refuse_leaks(df, "p", ["k"]).count()


def test_future_rows_do_not_change_the_past(spark):
    rng = np.random.default_rng(1)
    rows = [("a", day("2020-01-01") + dt.timedelta(i), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(120, 2)))]

    def run(data):
        df = spark.createDataFrame(data, "k string, d date, x double, y double").withColumn("known", F.date_add("d", 3))
        return {r["d"]: (r["slope"], r["forecast"]) for r in P.slope_forecast(df, ["k"], "d", "known", "x", "y").collect()}

    a = run(rows)
    b = run([r if r[1] < day("2020-04-01") else (*r[:2], r[2] * 100, -r[3]) for r in rows])
    assert all(a[d] == pytest.approx(b[d]) for d in a if d < day("2020-04-01") and a[d][0] is not None)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    n = 60 - 2
    assert a[rows[60][1]][0] == pytest.approx((x[:n] * y[:n]).sum() / (x[:n] ** 2).sum())


def test_recency_fit_is_the_weighted_line(spark):
    rng = np.random.default_rng(2)
    n = 1300
    x, y = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k string, i int, x double, y double")
    got = {r["i"]: r["slope"] for r in P.recency_fit(df, ["k"], "i", "x", "y").collect()}
    for i in (40, 511, 512, 513, 1200):
        w = 0.5 ** ((i - np.arange(i)) / 10)
        mx, my = (w * x[:i]).sum() / w.sum(), (w * y[:i]).sum() / w.sum()
        assert got[i] == pytest.approx((w * (x[:i] - mx) * (y[:i] - my)).sum() / (w * (x[:i] - mx) ** 2).sum(), rel=1e-6)


def test_stores(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 3.0), (2, 4.0), (3, 1.0)], "k int, v double")
    as_dict = lambda d: {r["k"]: r["v"] for r in d.collect()}
    assert as_dict(stores.upgraded(a, b, ["k"], "v")) == {1: 5.0, 2: 4.0, 3: 1.0}
    assert as_dict(stores.fill_missing(a, b, ["k"], ["v"])) == {1: 5.0, 2: 4.0, 3: 1.0}
    assert as_dict(stores.new_rows(a, b, ["k"])) == {3: 1.0}
    assert as_dict(stores.newest_wins(a, b, ["k"])) == {1: 3.0, 2: 4.0, 3: 1.0}


def test_append_twice_adds_nothing(spark, tmp_path):
    b = spark.createDataFrame([(1, 3.0), (2, 4.0)], "k int, v double")
    for _ in range(2):
        stores.append_new(spark, b, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    stores.replace(b.where("k = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_json_lines_skip_malformed(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    from pyspark.sql import types as t

    assert {r["a"] for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), t.StructType([t.StructField("a", t.LongType())])).collect()} == {1, 2}


def test_xml_and_api_rows(spark):
    x = spark.createDataFrame([("<f><e><d>1</d><v>2.5</v></e><e><d>2</d><v>3</v></e></f>",)], "b string")
    assert [tuple(r) for r in readers.xml_rows(x, "b", "f/e", {"d": "d", "v": "v"}).collect()] == [("1", "2.5"), ("2", "3")]
    j = spark.createDataFrame([('{"rows": [{"a": 1}, {"a": 2}]}',)], "b string")
    assert [r["a"] for r in readers.api_rows(j, "b", "struct<a: int>").collect()] == [1, 2]


def test_unknown_switch_fails(spark):
    df = spark.createDataFrame([("x", True)], "name string, enabled boolean")
    with pytest.raises(Exception):
        readers.flags(df, ["y"]).count()


def test_tails():
    assert T.normal_quantile(0.975) == pytest.approx(T.Z95, abs=1e-9)
    assert T.student_tail(2.228138852, 10) == pytest.approx(0.025, abs=1e-8)
    assert T.binomial_lower(3, 10, 0.5) == pytest.approx(sum(math.comb(10, k) for k in range(4)) / 1024)
    assert T.mcnemar(5, 5) == 1.0 and T.mcnemar(10, 0) == pytest.approx(2 / 1024)
    assert T.chi_square_tail_1(3.841458820694124) == pytest.approx(0.05, abs=1e-9)
    assert T.sample_size(0.5, 1.0) == 32


def test_normal_cdf_column(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "x double").select("x", T.normal_cdf(F.col("x")).alias("p"))
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=2e-7) for r in df.collect())


def test_diebold_mariano_column_equals_function(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=80) ** 2, rng.normal(size=80) ** 2
    df = spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k string, i int, a double, b double")
    assert T.diebold_mariano_by(df, ["k"], "i", "a", "b", 4).first()["dm_stat"] == pytest.approx(T.diebold_mariano(a, b, lags=4)["stat"])


def test_garch_recovers_persistence():
    rng = np.random.default_rng(4)
    r, v = [], 1e-4
    for _ in range(3000):
        r.append(math.sqrt(v) * rng.normal())
        v = 5e-6 + 0.1 * r[-1] ** 2 + 0.85 * v
    m = M.fit_garch(np.array(r))
    assert 0.85 < m["alpha"] + m["beta"] < 0.995


def test_kalman_learns_offsets():
    rng = np.random.default_rng(5)
    level = np.cumsum(rng.normal(size=300)) + 100
    obs = np.stack([level + rng.normal(size=300) * 0.5, level + 7 + rng.normal(size=300) * 0.5], 1)
    obs[200:, 0] = np.nan
    got, _ = M.kalman_level(obs, np.zeros_like(obs), 1.0, np.array([0.25, 0.25]))
    assert np.abs(got[250:] - level[250:]).mean() < 1.0


def test_turnbull_and_quantile_line():
    ends, p = M.turnbull(np.array([0.0, 0, 1, 1]), np.array([1.0, 1, 2, 2]))
    assert p == pytest.approx([0.5, 0.5]) and list(ends) == [1, 2]
    x = np.linspace(0, 1, 500)
    y = 2 + 3 * x + np.random.default_rng(6).normal(size=500)
    b = M.quantile_line(np.stack([np.ones(500), x], 1), y, 0.8)
    assert abs((y <= b[0] + b[1] * x).mean() - 0.8) < 0.03


def test_huber_resists_outliers():
    x = np.arange(50.0)
    y = 2 * x + 1
    y[::10] += 500
    a, b = P.huber_line(x, y, np.ones(50))
    assert a == pytest.approx(2, abs=0.05)


def test_gate_order(spark):
    df = spark.createDataFrame([(10, True, 0.2, 0.25, 0.6, 0.5, 0.05), (40, True, 0.3, 0.25, 0.6, 0.5, 0.05), (40, True, 0.2, 0.25, 0.6, 0.5, 0.05), (None, True, 0.2, 0.25, 0.6, 0.5, 0.05)], "n int, significant boolean, brier double, base_brier double, accuracy double, base_accuracy double, ece double")
    ok, why = G.direction_gate()
    assert [tuple(r) for r in df.select(ok, why).collect()] == [(False, "too few folds"), (False, "brier not better"), (True, None), (False, "missing metrics")]


def test_sticky(spark):
    df = spark.createDataFrame([("a", i, b) for i, b in enumerate([True, True, True, False, False, True, False, False, False])], "k string, i int, b boolean")
    assert [r["demoted"] for r in G.sticky(df, ["k"], "i", "b").orderBy("i").collect()] == [False, False, True, True, True, True, True, True, True]  # clean checks do not undo it


def test_cooldown_rules():
    rule = ST.Cooldown(hours=10, most=2, quiet=(22, 7), shift_hours=0)
    out, _, _ = rule.run([(8, "a"), (9, "a"), (10, "b"), (11, "c"), (23, "a"), (30, "d")], [], {}, now=32)
    assert out == [(8, "a", 8), (10, "b", 10), (32, "a", 23)] or out == [(8, "a", 8), (10, "b", 10)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, dt.datetime(2024, 1, 1 + i % 9, (7 * i) % 24), ["x", "y", "z"][i % 3]) for i in range(90) for u in (1, 2)]
    df = spark.createDataFrame(rows, "u int, ts timestamp, trig string")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    rule = ST.Cooldown(hours=24, most=3)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = ST.cooldown_stream(stream, "u", "ts", "trig", rule).writeStream.format("memory").queryName("cool").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    got = {tuple(r) for r in ST.memory_rows(q, spark, "cool").collect()}
    assert got == {tuple(r) for r in ST.cooldown_batch(df, "u", "ts", "trig", rule).collect()} and got


def test_append_once_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "k int, ts timestamp")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    q = ST.append_once(spark.readStream.schema(df.schema).parquet(src), ["k"], "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    assert ST.memory_rows(q, spark, "once").count() == 2


def test_upsert_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 2.0)], "k int, v double").coalesce(1).write.parquet(src)
    q = ST.upsert_batches(spark.readStream.schema("k int, v double").parquet(src), out, ["k"], "v", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, 5.0), (2, 2.0)}


def test_every_trigger_fires_somewhere(spark):
    s = spark.createDataFrame([(1, -5.0, 4.0, 1000.0, 800.0, day("2024-01-07"), 18, False, True, False, True, False, 4, 5, 3, 3, "last_known", 2, 40.0, 500.0, 100.0, True, "p4", "p3", True, False, 12, False)], "id int, momentum_7d double, momentum_limit double, price double, previous_different_price double, local_day date, local_hour int, digest_sent_this_week boolean, probe_failed boolean, model_degraded boolean, calibration_valid boolean, calibration_seen boolean, days_since_alert int, benchmark_business_days int, snapshot_days int, usable_snapshot_weekdays int, source_tier string, failure_streak int, reading_hours_without_sundays double, fix double, previous_fix double, demoted boolean, champion string, previous_champion string, coverage_alert boolean, coverage_alert_sent boolean, forward_days int, first_look_sent boolean")
    got = {r["trigger"] for r in ST.fired(s, ["id"]).collect()}
    assert got == set(ST.triggers()) - {"momentum_up", "digest_morning", "benchmark_stale"}


def test_hours_without_sundays(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 12), dt.datetime(2024, 1, 8, 12)), (dt.datetime(2024, 1, 7, 6), dt.datetime(2024, 1, 7, 12))], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(S.hours_without_sundays("a", "b")).collect()] == [24.0, 0.0]


def test_splice_needs_overlap(spark):
    old = spark.createDataFrame([(day("2020-01-01") + dt.timedelta(i), 2.0) for i in range(30)], "d date, v double")
    new = spark.createDataFrame([(day("2020-01-26") + dt.timedelta(i), 4.0) for i in range(30)], "d date, v double")
    assert {r["segment"] for r in R.splice(old, new, "d", "v").collect()} == {"new"}
    assert {r["v"] for r in R.splice(old, new, "d", "v", 3).collect()} == {4.0}


def test_adaptive_level_keeps_coverage():
    e = np.abs(np.random.default_rng(8).normal(size=2000)) * np.linspace(1, 3, 2000)
    half, _ = P.adaptive_level(e)
    ok = np.isfinite(half)
    assert abs((e[ok] <= half[ok]).mean() - 0.8) < 0.04


def test_quote_source(spark):
    from tidemark.sources.quotes import QuoteSource

    spark.dataSource.register(QuoteSource)
    d = spark.read.format("quotes").option("fetch", "tests.quote_fixture:fetch").option("tickers", "AA,BAD,C").option("wait", "0").load()
    got = sorted((r["ticker"], r["day"].day, r["value"]) for r in d.collect())
    assert [g[:2] for g in got] == [("AA", 1), ("AA", 2), ("AA", 3), ("C", 1), ("C", 2), ("C", 3)] and got[0][2] == 2.0 and got[1][2] is None
    strict = spark.read.format("quotes").option("fetch", "tests.quote_fixture:fetch").option("wait", "0").option("failed", "error")
    assert strict.option("tickers", "AA,C").load().count() == 6
    with pytest.raises(Exception, match="no answer"):
        strict.option("tickers", "AA,BAD").load().collect()


def test_folds(spark):
    from tidemark.plans.policies import Folds

    got = [tuple(r) for r in Folds(F.lit(25), F.lit(10), F.lit(5), F.lit(2)).collect()]
    assert got == [(0, 10, 12, 17), (1, 15, 17, 22), (2, 20, 22, 25)]


def test_predicates(spark):
    from tidemark.operators import predicates as X

    df = spark.createDataFrame([("a", day("2024-01-05"), 1.0, None), ("a", day("2024-01-06"), 1.0, False), ("a", day("2024-01-08"), 2.0, True)], "k string, d date, v double, retro boolean")
    assert [r["c"] for r in df.select("d", X.weekend_carry(["k"], "d", "v").alias("c")).orderBy("d").collect()] == [False, True, False]
    assert df.where(X.live_only("retro")).count() == 1 and df.where(X.live_only("retro", False)).count() == 2
    assert X.last_complete(df, ["k"], "d", ["v"]).first()["v"] == 2.0
    assert X.sub_period(df, "d", "2024-01-05", "2024-01-08").count() == 2 and X.every_kth(df, ["k"], "d", 2).count() == 2
    with pytest.raises(Exception):
        X.must_be_positive(df.withColumn("v", F.col("v") - 1), "v").count()


def test_autocorrelation(spark):
    x = np.random.default_rng(9).normal(size=200).cumsum()
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i int, v double")
    r = W.autocorrelation(df, ["k"], "i", "v", 3).first()
    z = x - x.mean()
    acf = [(z[k:] * z[:-k]).sum() / (z * z).sum() for k in (1, 2, 3)]
    assert [r["acf1"], r["acf2"], r["acf3"]] == pytest.approx(acf)
    assert r["ljung_box"] == pytest.approx(200 * 202 * sum(a * a / (200 - k) for k, a in enumerate(acf, 1)))


def test_event_between_any_span_and_equal_rows(spark):
    import datetime as dt

    day = lambda y, m, d: dt.date(y, m, d)
    left = spark.createDataFrame([(1, day(2000, 1, 1), day(2020, 1, 1)), (2, day(2019, 1, 1), day(2019, 2, 1)), (2, day(2019, 1, 1), day(2019, 2, 1)), (3, day(2019, 2, 1), day(2019, 3, 1)), (4, day(2019, 1, 1), None), (5, None, day(2019, 3, 1))], "i int, a date, b date")
    events = spark.createDataFrame([(day(2019, 2, 1),), (day(2030, 1, 1),)], "e date")
    assert sorted(r["i"] for r in J_events(left, events).collect()) == [1, 2, 2]
    assert J_events(left, events.limit(0)).count() == 0


def J_events(left, events):
    from tidemark.operators.joins import with_event_between

    return with_event_between(left, events, "a", "b", "e")


def test_long_half_lives(spark):
    """Weights reach as far as the half-life asks for, and no power overflows where it is short."""
    from tidemark.operators.windows import ewma
    from tidemark.plans.walkforward import recency_fit

    rng = np.random.default_rng(4)
    n = 3000
    x, y = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([("a", i, float(x[i]), float(y[i]) + 2 * float(x[i]) * (i > 1500)) for i in range(n)], "k string, i int, x double, y double")
    yy = y + 2 * x * (np.arange(n) > 1500)
    for half in (1000.0, 0.25):
        w = 0.5 ** (np.arange(n - 1)[::-1] / half)
        mx, my = np.average(x[:-1], weights=w), np.average(yy[:-1], weights=w)
        want = np.average((x[:-1] - mx) * (yy[:-1] - my), weights=w) / np.average((x[:-1] - mx) ** 2, weights=w)
        got = recency_fit(df, ["k"], "i", "x", "y", halflife=half).where(f"i = {n - 1}").first()["slope"]
        assert got == pytest.approx(want, rel=1e-6)
        assert ewma(df, ["k"], "i", "y", half, "e").where(f"i = {n - 1}").first()["e"] == pytest.approx(my, rel=1e-9)


def test_null_times_match_nothing(spark):
    left = spark.createDataFrame([("a", None), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 1.0), ("a", 7, 2.0)], "k string, u int, v double")
    from tidemark.operators.asof import asof_join

    for direction, want in (("forward", 2.0), ("backward", 1.0)):
        assert {r["t"]: r["v"] for r in asof_join(left, right, ["k"], "t", "u", ["v"], direction).collect()} == {None: None, 5: want}


def test_null_p_values_are_left_out(spark):
    from tidemark.functions.stats import benjamini_hochberg

    d = spark.createDataFrame([("a", 1, 0.01), ("a", 2, None), ("a", 3, 0.04)], "k string, i int, p double")
    got = {r["i"]: (r["p_bh"], r["reject_bh"]) for r in benjamini_hochberg(d, ["k"], "p").collect()}
    assert got[2] == (None, False) and got[1] == (pytest.approx(0.03), True) and got[3] == (pytest.approx(0.06), False)


def test_xml_entries_keep_to_themselves(spark):
    x = spark.createDataFrame([(7, "<f><e><d>1</d></e><e a='1'>\n<d>2</d><v>20</v></e><e/><e><v>30</v></e></f>"), (8, "<f/>")], "i int, b string")
    assert [tuple(r) for r in readers.xml_rows(x, "b", "f/e", {"d": "d", "v": "v"}).collect()] == [(7, "1", None), (7, "2", "20"), (7, None, None), (7, None, "30")]


def test_store_keeps_columns_and_survives_a_crash(spark, tmp_path):
    a = spark.createDataFrame([(1, None, "x"), (2, 4.0, "y")], "k int, v double, note string")
    b = spark.createDataFrame([(1, 5.0), (1, 6.0), (3, 1.0)], "k int, v double")
    got = {r["k"]: (r["v"], r["note"]) for r in stores.fill_missing(a, b, ["k"], ["v"]).collect()}
    assert got == {1: (5.0, "x"), 2: (4.0, "y"), 3: (1.0, None)}
    at = str(tmp_path / "s")
    stores.replace(a, at)
    stores.replace(b, at)
    assert spark.read.parquet(at).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["s"]
    (tmp_path / "s").rename(tmp_path / "s.old")  # as a crash between the two moves leaves it
    stores.recover(spark, at)
    assert spark.read.parquet(at).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["s"]


def crash_points(spark, base, old, new):
    """The folders that a replace broken off at each of its steps leaves, and the rows that then count."""
    for name, aside, inside, marked, rows in (("written", None, old, False, old), ("aside", old, None, False, old), ("moved", old, new, True, new), ("deleted", None, new, True, new)):
        at = base / name / "s"
        new.write.parquet(str(at) + ".next-1")
        if aside is not None:
            aside.write.parquet(str(at) + ".old")
        if inside is not None:
            inside.write.parquet(str(at))
            if marked:
                (at / stores.MARK).touch()
        yield name, str(at), {r["k"] for r in rows.collect()}


def test_store_keeps_its_rows_at_every_crash_point(spark, tmp_path):
    old, new, one = (spark.createDataFrame([(k, 1.0) for k in ks], "k int, v double") for ks in ((1, 2, 3, 4, 5), (1, 2, 3, 4, 5, 6), (9,)))
    keys = lambda at: {r["k"] for r in spark.read.parquet(at).collect()}
    for name, at, rows in crash_points(spark, tmp_path / "append", old, new):
        stores.append_new(spark, one, at, ["k"])
        assert keys(at) == rows | {9}, name
        stores.replace(stores.opened(spark, at, old.schema).where("k <> 1"), at)
        assert keys(at) == rows - {1} | {9}, name
    for name, at, rows in crash_points(spark, tmp_path / "upgrade", old, new):
        stores.replace(stores.upgraded(readers.parquet_or_empty(spark, at, old.schema), one, ["k"], "v"), at)
        assert keys(at) == rows | {9}, name
    src = str(tmp_path / "src")
    one.write.parquet(src)
    for name, at, rows in crash_points(spark, tmp_path / "stream", old, new):
        q = ST.upsert_batches(spark.readStream.schema("k int, v double").parquet(src), at, ["k"], "v", str(tmp_path / f"c-{name}")).start()
        q.awaitTermination()
        assert keys(at) == rows | {9}, name


def test_a_store_begun_anew_is_never_deleted(spark, tmp_path):
    at = str(tmp_path / "s")
    for path, n in ((at, 1), (at + ".old", 5)):
        spark.range(n).write.parquet(path)
    for use in (lambda: stores.recover(spark, at), lambda: stores.replace(spark.range(2), at), lambda: stores.append_new(spark, spark.range(2), at, ["id"])):
        with pytest.raises(OSError):
            use()
    assert spark.read.parquet(at).count() == 1 and spark.read.parquet(at + ".old").count() == 5


def test_forward_window_needs_consecutive_days_and_a_row_after_it(spark):
    import datetime as dt

    from tidemark.operators import series

    def plain(days, most=2):
        import numpy as np

        out = {}
        for i, t in enumerate(days):
            end, j, ok = t + dt.timedelta(7), i + 1, True
            near = lambda a, b: np.busday_count(a, b) <= most
            while j < len(days) and days[j] <= end:
                ok &= bool(near(days[j - 1], days[j]))
                j += 1
            out[t] = j - i - 1 if ok and j < len(days) and near(days[j - 1], days[j]) and j > i + 1 else None
        return out

    first = dt.date(2024, 1, 1)
    cases = [[0, 1, 7], [0, 1, 8], [0, 1, 2, 3, 4, 7, 8, 9], [0, 3, 4, 7, 10, 11, 12, 20, 21, 22, 24, 28, 29, 30, 33]]
    for case in cases:
        days = [first + dt.timedelta(k) for k in case]
        d = spark.createDataFrame([(1, t, float(k)) for k, t in enumerate(days)], "k int, d date, v double")
        assert {r["d"]: r["path_n"] for r in series.forward_window(d, ["k"], "d", "v").collect()} == plain(days)


def test_demotion_windows_and_still_losses(spark):
    from tidemark.functions.stats import student_upper
    from tidemark.plans import demotion

    rows = [(1, i, 0) for i in range(30)] + [(1, 30 + i, None if i % 2 else 1) for i in range(60)]
    d = spark.createDataFrame(rows, "k int, i int, hit int")
    last = {r["i"]: r for r in demotion.rate_breach(d, ["k"], "i", "hit", 60, 0.55).collect()}
    assert len(last) == 90 and last[89]["breach_p"] == pytest.approx(1.0) and not last[89]["breach"] and last[40]["breach"]
    for level, breach, p in ((5.0, True, 0.0), (-5.0, False, 1.0), (0.0, False, 1.0)):
        x = spark.createDataFrame([(1, i, level) for i in range(35)], "k int, i int, z double")
        got = {r["i"]: (r["stat"], r["p_worse"], r["breach"]) for r in demotion.error_breach(x, ["k"], "i", "z").collect()}
        assert got[34] == (None, p, breach) and got[28] == (None, None, False)
    known = {(2.131846786326649, 4): 0.05, (1.9431802805153022, 6): 0.05, (2.015048372669157, 5): 0.05, (6.313751514675037, 1): 0.05, (0.0, 3): 0.5, (-2.3533634348018264, 3): 0.95}
    for (t, n), p in known.items():
        assert spark.range(1).select(student_upper(F.lit(t), n)).first()[0] == pytest.approx(p, abs=1e-9)
