"""Ordered operators on hot keys give what the plain ones give, in many pieces."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, hot

T0 = dt.datetime(2024, 1, 1)


def sides(spark, n=600, seed=4):
    """One key with nearly all rows, a moment shared by many left rows, a gap without right rows, small keys and a null one."""
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.95 else rng.choice(["a", "b", None])
    left = [(key(), T0 + dt.timedelta(minutes=500 if i % 5 == 0 else rng.randrange(2000)), i) for i in range(n)] + [("hot", None, -1)]
    seen = {(key(), T0 + dt.timedelta(minutes=m)) for m in [*range(100, 900, 7), *range(1700, 2000, 3)]}
    right = [(k, t, i) for i, (k, t) in enumerate(sorted(seen, key=str))]
    return spark.createDataFrame(left, "k string, t timestamp, id int"), spark.createDataFrame(right, "k string, u timestamp, v int")


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("rows", [10, 64, 10_000])
def test_asof_equals_the_plain_join(spark, exact, rows):
    left, right = sides(spark)
    plain = asof.asof_join(left, right, ["k"], "t", "u", ["v"], allow_exact=exact)
    got = hot.asof_backward(left, right, ["k"], "t", "u", ["v"], exact, rows)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_a_hot_key_is_cut(spark):
    left, _ = sides(spark)
    p = hot.pieces(left, ["k"], "t", 20)
    sizes = {(r.k, r.piece): r["count"] for r in p.where("t is not null").groupBy("k", "piece").count().collect()}
    assert len([1 for k, _ in sizes if k == "hot"]) > 15 and all(piece == 0 for k, piece in sizes if k in ("a", "b"))
    one = p.where("k = 'hot'").groupBy("t").agg(F.countDistinct("piece").alias("n")).agg(F.max("n")).first()[0]
    assert one == 1  # equal times stay together
    big = sorted(n for (k, _), n in sizes.items() if k == "hot")
    assert big[-2] <= 3 * 20  # all but the piece of the shared moment
    order = p.where("k = 'hot'").select(F.max("piece").over(Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)).alias("m"), "piece").where("m <> piece and piece > 0").count()
    assert order == 0


def test_pieces_are_bounded(spark):
    left, _ = sides(spark)
    assert hot.pieces(left, ["k"], "t", 1, most=8).where("k = 'hot'").agg(F.countDistinct("piece")).first()[0] <= 9


@pytest.mark.parametrize("rows", [9, 10_000])
def test_fill_forward(spark, rows):
    d = spark.range(300).select(F.when(F.col("id") % 50 == 7, "b").otherwise("a").alias("k"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("t"), F.when((F.col("id") % 13 == 5) & ~F.col("id").between(80, 200), F.col("id")).alias("v"), F.when(F.col("id") == 3, "x").alias("s"))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = d.withColumns({f"{c}_filled": F.last(c, True).over(w) for c in "vs"})
    assert sorted(map(str, hot.fill_forward(d, ["k"], "t", ["v", "s"], rows).collect())) == sorted(map(str, want.collect()))


def test_no_rows(spark):
    left, right = sides(spark)
    assert hot.asof_backward(left.where("false"), right, ["k"], "t", "u", ["v"], rows=5).count() == 0
    rows = hot.asof_backward(left, right.where("false"), ["k"], "t", "u", ["v"], rows=5).collect()
    assert len(rows) == left.count() and all(r.v is None for r in rows)


def test_a_long_schedule_is_not_broadcast(spark, monkeypatch):
    left = spark.range(50).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    steps = spark.range(12).select(F.date_add(F.lit("2024-01-06").cast("date"), (F.col("id") * 3).cast("int")).alias("eff"), F.col("id").cast("double").alias("pct"))
    short = sorted(map(str, asof.step_schedule(left, steps, "d", "eff", "pct", -1.0).select("d", "pct").collect()))
    monkeypatch.setattr(asof, "MOST_STEPS", 5)
    assert sorted(map(str, asof.step_schedule(left, steps, "d", "eff", "pct", -1.0).select("d", "pct").collect())) == short
