"""Source evaluators: each planted fault gives its finding, clean rows give none, and large series are cut without a change."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hot as H
from tidemark.operators import source_checks as C

RATE = C.Range(60, 200, 80, 180)
STEPS = C.Steps(0.1, 0.2)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def codes(df):
    return sorted(((r.place, r.field, r.code) for r in df.collect()), key=str)


def readings(spark, data, **more):
    d = spark.createDataFrame([(1, *r) for r in data], "k int, p long, t string, a double, b double, l string")
    return codes(C.readings(d, now(), ["k"], "p", "t", {"a": RATE, "b": C.Range(60, 220)}, [C.Pair("b", "a", 24 / 22, 0.005, 0.02)], "l", "a", STEPS, **more))


def test_clean_readings(spark):
    assert readings(spark, [(i, f"2024-01-{29 + i}T06:00:00Z", 110.0, 120.0, "x") for i in range(3)]) == []


def test_faults_of_readings(spark):
    rows = [(1, "2024-01-20T00:00:00Z", 110.0, 120.0, "x"), (2, "2024-01-20T00:00:00Z", 110.0, 121.0, " "), (3, "2024-01-21T00:00:00", 1100.0, 120.0, "x"), (4, "soon", 11.0, 120.0, "x"),
            (5, "1970-01-01T00:00:00Z", -1.0, 120.0, "x"), (6, "2024-02-03T00:00:00Z", 125.0, float("nan"), "x"), (7, None, None, 120.0, None)]
    got = readings(spark, rows)
    assert got == sorted([("2", "t", "DUPLICATE_KEY"), ("2", "t", "TS_NOT_AFTER_PREVIOUS"), ("2", "b/a", "RATIO_WARN"), ("2", "l", "SCHEMA_BAD_TYPE"), ("3", "t", "TS_NAIVE"), ("3", "a", "UNIT_SUSPECT_PER_10G"),
                          ("4", "t", "TS_UNPARSEABLE"), ("4", "a", "UNIT_SUSPECT_PER_G"), ("5", "t", "TS_EPOCH_PLACEHOLDER"), ("5", "a", "VALUE_NON_POSITIVE"), ("6", "t", "TS_FUTURE"), ("6", "t", "GAP_BLOCK"), ("6", "a", "JUMP_WARN"),
                          ("6", "b", "VALUE_NOT_FINITE"), ("7", "t", "TS_UNPARSEABLE"), ("7", "a", "VALUE_NOT_NUMERIC"), ("7", "l", "SCHEMA_BAD_TYPE")], key=str)
    assert readings(spark, rows, rows=1) == got


def test_missing_columns_and_no_rows(spark):
    d = spark.createDataFrame([], "k int, p long, t string")
    assert [x[1:] for x in codes(C.outcomes(d, now(), ["k"], "p", "t", "o", ["ok"]))] == [("o", "SCHEMA_MISSING_FIELD")]
    assert codes(C.outcomes(d.withColumn("o", F.lit("ok")), now(), ["k"], "p", "t", "o", ["ok"])) == [(None, "newest", "EMPTY_SOURCE")]


def test_outcomes(spark):
    d = spark.createDataFrame([(1, 1, "2024-01-20T00:00:00Z", "ok", "true"), (1, 2, "2024-01-19T00:00:00Z", "odd", "maybe"), (1, 3, "2024-01-24T00:00:00Z", "ok", None)], "k int, p long, t string, o string, blocked string")
    assert codes(C.outcomes(d, now(), ["k"], "p", "t", "o", ["ok"], "blocked")) == sorted([("2", "o", "SCHEMA_UNKNOWN_VALUE"), ("2", "blocked", "SCHEMA_BAD_TYPE"), ("2", "t", "TS_NOT_AFTER_PREVIOUS"), ("3", "t", "GAP_WARN"), (None, "newest", "STALE_BLOCK")], key=str)


def fixes(spark, data, **more):
    d = spark.createDataFrame([(1, *r) for r in data], "k int, p long, day string, f string, am double, aml double, pm double, pml double")
    lo = C.Range(20, 100)
    pairs = [C.Pair("aml", "am", 0.5, 0.05, 0.2), C.Pair("pml", "pm", 0.5, 0.05, 0.2)]
    return C.fixes(d, now(), ["k"], "p", "day", "f", {"am": RATE, "aml": lo}, {"pm": RATE, "pml": lo}, pairs, ("am", "pm"), (0.03, 0.06), STEPS, **more)


def test_fixes(spark):
    f = "2024-01-31T00:00:00Z"
    rows = [(1, "2024-01-26", f, 100.0, 50.0, 100.0, 50.0), (2, "2024-01-29", f, None, 50.0, 100.0, 50.0), (3, "2024-01-29", f, 100.0, 50.0, 104.0, 52.0), (4, "2024-01-10", f, 100.0, 70.0, 100.0, 50.0), (5, "31/01/2024", f, 1.0, 1.0, None, None),
            (6, "2024-01-31", f, 150.0, 75.0, None, None)]
    want = [("2", "morning", "NULL_VALUE"), ("3", "day", "DUPLICATE_KEY"), ("3", "pm/am", "RATIO_WARN"), ("4", "aml/am", "RATIO_BLOCK"), ("4", "day", "TS_ORDER"), ("1", "day", "GAP_BLOCK"), ("5", "day", "TS_UNPARSEABLE"), ("6", "pm", "JUMP_BLOCK")]
    want = sorted(want, key=str)
    assert codes(fixes(spark, rows)) == want
    assert codes(fixes(spark, rows, rows=1)) == want


def test_working_days(spark):
    """Days from Monday to Friday after the first, up to the second; counted one by one here."""
    days = [dt.date(2023, 12, 20) + dt.timedelta(n) for n in range(16)]
    pairs = [(a, b) for a in days for b in days if a <= b]
    plain = lambda a, b: sum((a + dt.timedelta(n)).weekday() < 5 for n in range(1, (b - a).days + 1))
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", C.working_days(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == plain(r.a, r.b) for r in got)


def test_snapshots(spark):
    rows = [(1, "2024-01-31T00:00:00Z", "2024-01-31T00:00:00Z", "A", None, 100.0, "x"), (2, "2024-01-31T00:00:00Z", "2024-01-28T00:00:00Z", "B", None, 112.0, "x"), (3, "2024-01-31T00:00:00Z", "2024-01-31T00:00:00Z", "A", "Rome", 100.0, ""),
            (4, "2024-01-30T00:00:00Z", "2024-01-30T00:00:00Z", "R", "Oslo", 100.0, "x"), (5, "2024-01-30T06:00:00Z", "2024-01-30T07:00:00Z", "R", "Bonn", 100.0, "x"), (6, "2024-01-31T00:00:00Z", "2024-01-31T00:00:00Z", "Z", None, 100.0, "x")]
    d = spark.createDataFrame(rows, "p long, cap string, obs string, part string, city string, rate double, who string")
    got = codes(C.snapshots(d, now(), "p", "cap", "obs", "part", "city", "rate", RATE, STEPS, ["A", "B", "N"], {"R": ["Oslo"]}, {"B": (24, 96)}, (0.05, 0.10), texts=("who",)))
    assert set(got) == {("2", "obs", "STALE_WARN"), ("3", "city", "SCHEMA_UNKNOWN_VALUE"), ("3", "who", "SCHEMA_BAD_TYPE"), ("5", "city", "SCHEMA_UNKNOWN_VALUE"), ("5", "obs", "TS_FUTURE"), ("4", "cap", "TS_ORDER"), ("5", "cap", "TS_ORDER"),
                        ("6", "part", "SCHEMA_UNKNOWN_VALUE"), ("2024-01-31 00:00:00", "parts", "CROSS_SOURCE_BLOCK"), ("N", "newest", "STALE_BLOCK"), ("R", "newest", "STALE_WARN")}


def test_fused_outputs(spark):
    schema = "p int, cap string, day string, v double, h double, used array<string>, failures map<string,string>, cities map<string,double>"
    ok = (1, "2024-01-31T20:00:00Z", "2024-01-31", 100.0, 5.0, ["A"], {}, {"Oslo": 100.0})
    bad = [(2, *ok[1:3], None, None, [], {"B": "timeout"}, {}), (3, *ok[1:3], 100.0, 15.0, ["A"], {}, {"Rome": 1000.0}), (4, ok[1], "today", 100.0, -1.0, [], {}, {})]
    run = lambda rows: codes(C.fused_outputs(spark.createDataFrame(rows, schema), now(), "p", "cap", "day", "v", "h", "used", RATE, ["failures"], "cities"))
    assert run([ok]) == []
    assert run([ok, *bad]) == sorted([("2", "v", "NULL_VALUE"), ("2:B", "failures", "SOURCE_REPORTED_FAILURE"), ("3", "h", "VALUE_OUT_OF_RANGE"), ("3:Rome", "city", "UNIT_SUSPECT_PER_10G"), ("4", "day", "TS_UNPARSEABLE"), ("4", "h", "VALUE_NOT_NUMERIC"), ("4", "used", "SCHEMA_BAD_TYPE")], key=str)


def test_feature_store(spark):
    cap = "2024-01-31T00:00:00Z"
    rows = [(1, cap, "2024-01-29", "live", 3, 100.0, "2024-01-29", 1000.0, "2024-01-29"), (2, cap, "2024-01-30", "live", 3, 150.0, "2024-01-31", 1000.0, "2024-01-01"), (3, cap, "2024-01-30", "live", 1, 150.0, None, None, None), (4, cap, "2024-01-31", "live", 3, None, None, 1000.0, None)]
    d = spark.createDataFrame(rows, "p int, cap string, day string, part string, ver int, a double, a_asof_date string, b double, b_asof_date string")
    got = codes(C.feature_store(d, now(), "p", "cap", "day", "part", {"a": RATE, "b": C.Range(500, 2000)}, ["a"], {"a": STEPS}, "ver", band=("a", "b", 10.0, (0.95, 1.08), (0.85, 1.2))))
    assert got == sorted([("2", "a", "JUMP_BLOCK"), ("2", "a_asof_date", "TS_FUTURE"), ("2", "b_asof_date", "STALE_WARN"), ("2", "a/b", "CROSS_SOURCE_BLOCK"), ("3", "day", "DUPLICATE_KEY"), ("3", "a_asof_date", "SCHEMA_MISSING_FIELD"), ("4", "a", "NULL_VALUE"), ("4", "b_asof_date", "TS_UNPARSEABLE")], key=str)


def test_frame_and_seed(spark):
    rows = [(1, "2024-01-29", 100.0, True), (2, "2024-01-30", None, True), (3, "2024-01-29", 100.0, None), (4, "2024-01-31", 190.0, True)]
    d = spark.createDataFrame(rows, "p int, day string, v double, flag boolean").withColumn("at", F.col("day").cast("timestamp"))
    assert codes(C.frame(d, now(), "p", "at", {"v": RATE}, {"v": STEPS}, ["v"]).where("place is not null")) == sorted([("2", "v", "NULL_VALUE"), ("4", "v", "JUMP_BLOCK"), ("4", "v", "VALUE_OUTSIDE_HISTORY")], key=str)
    assert {r.code for r in C.frame(d, now(), "p", "at", {"v": RATE}, {"v": STEPS}).where("place is null").collect()} == {"TS_ORDER", "DUPLICATE_KEY"}
    got = C.seed(d, now(), "p", "at", ["v"], RATE, "v", STEPS, ["flag"])
    assert codes(got.where("place is not null")) == sorted([("2", "v", "VALUE_NOT_NUMERIC"), ("3", "flag", "SCHEMA_BAD_TYPE"), ("4", "v", "JUMP_BLOCK"), ("4", "v", "VALUE_OUTSIDE_HISTORY")], key=str)
    b = spark.createDataFrame([("2024-01-29", 120.0), ("2024-01-31", 100.0)], "day string, w double")
    assert {r.code for r in C.two_seeds(d.where("p <> 3"), b, "day", "v", "w").collect()} == {"CROSS_SOURCE_WARN", "CROSS_SOURCE_BLOCK"}


def test_reports(spark):
    a = spark.createDataFrame([("x", "1", "f", "A", 1), ("x", "2", "f", "A", 2)], C.FINDINGS)
    assert {tuple(r) for r in C.reports([a], ["x", "y"]).collect()} == {("x", "block", 0, 1, 1), ("y", "ok", 0, 0, 0)}


@pytest.mark.parametrize("rows", [1, 7, 10**6])
def test_states_before(spark, rows):
    """Against a plain loop; one key holds nearly all rows."""
    g = random.Random(4)
    data = [("hot" if g.random() < 0.9 else "cold", i, None if g.random() < 0.5 else g.randrange(50)) for i in range(300)]
    want, state = {}, {}
    for k, i, v in data:
        want[i] = state.get(k, (None, None))
        if v is not None:
            state[k] = (v, max(v, want[i][1] if want[i][1] is not None else v))
    d = spark.createDataFrame(data, "k string, i long, v int")
    got = H.states_before(d, ["k"], ["i"], {"last": F.col("v")}, {"top": F.col("v")}, rows=rows)
    assert {r.i: (r["last"], r["top"]) for r in got.collect()} == want
