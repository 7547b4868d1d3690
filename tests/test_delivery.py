"""Delivery of alerts: the stream equals the batch plan and a plain model; timers release a queue without a new row of its key."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.streaming import delivery as D

RULES = D.Rules({"move": D.Policy("cooldown", 6, public=True), "jump": D.Policy("cooldown", 2, public=True), "digest": D.Policy("daily", public=True), "unlocked": D.Policy("once"), "down": D.Policy("daily", bypass=True)}, expiry_hours=6, cap=3, shift_minutes=330)
START = dt.datetime(2024, 3, 1, 3, 0)


def plain(rows):
    """One pass over time for each key: releases before alerts of the same moment."""
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        alerts = sorted({(int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)), g) for q, t, g in rows if q == k and t is not None and g in RULES.policies})
        queue, last, recent, steps = {}, {}, [], []
        for at, g in alerts:
            end = None if RULES.policies[g].bypass else RULES.release(at)
            if end is None:
                steps.append((at, at, g))
            else:
                queue[g, end] = at
        steps += [(end, at, g) for (g, end), at in queue.items() if end - at <= RULES.expiry_hours * D.HOUR]
        for due, raised, g in sorted(steps):
            p = RULES.policies[g]
            recent = [s for s in recent if s > due - D.DAY]
            if p.kind == "cooldown":
                ok = len(recent) < RULES.cap and (g not in last or last[g] <= due - p.hours * D.HOUR)
            else:
                ok = g not in last or p.kind == "daily" and RULES.local_day(last[g]) != RULES.local_day(due)
            if ok:
                last[g] = due
                recent += [due] if p.kind == "cooldown" else []
                out.add((k, g, raised, due))
    return out


def alerts(seed, keys=4, n=160):
    r = random.Random(seed)
    rows = [(r.randrange(keys), START + dt.timedelta(minutes=r.randrange(60 * 24 * 5)), r.choice([*RULES.policies, "unknown"])) for _ in range(n)]
    return rows + rows[:5] + [(None, START, "move"), (1, None, "move"), (1, START, None)]


KIND = "k int, ts timestamp_ntz, g string"


def told(df):
    return {(r["k"], r["trigger"], r["a"], r["b"]) for r in df.select("k", "trigger", F.unix_micros("raised_at").alias("a"), F.unix_micros("sent_at").alias("b")).collect()}


def test_batch_equals_the_plain_model(spark):
    for seed in (1, 2):
        rows = alerts(seed)
        got = D.delivered(spark.createDataFrame(rows, KIND), "k", "ts", "g", RULES)
        assert told(got) == plain(rows) and {r["sink"] for r in got.where("trigger in ('unlocked', 'down')").collect()} == {"operations"}
    assert D.delivered(spark.createDataFrame([], KIND), "k", "ts", "g", RULES).count() == 0


def run(spark, tmp_path, name, batches, late="1 hour"):
    src = str(tmp_path / f"{name}-in")
    parts = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{src}/b={i:03}")
        parts.append(f"{src}/b={i:03}")
        stream = spark.readStream.schema("k int, ts timestamp, g string, b int").parquet(src)
        q = D.deliver_batches(D.delivered_stream(stream, "k", "ts", "g", RULES, late), "k", str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_stream_equals_batch_whatever_the_order_of_arrival(spark, tmp_path):
    rows = [r for r in alerts(7, 3, 90) if r[1] is not None]
    end = (99, START + dt.timedelta(days=30), "down")  # moves the watermark past all others
    late = lambda x, r: x[1] + dt.timedelta(minutes=r.randrange(50))
    r = random.Random(2)
    rows.sort(key=lambda x: late(x, r))
    got = run(spark, tmp_path, "s", [rows[:40], rows[40:], [end], [(99, end[1] + dt.timedelta(days=1), "down")]])
    assert {x for x in told(got) if x[0] != 99} == plain(rows)
    assert {r["sink"] for r in got.select("sink").distinct().collect()} == {"public", "operations"}


def test_a_timer_releases_without_a_new_row_of_its_key(spark, tmp_path):
    at = dt.datetime(2024, 3, 1, 20, 0)  # 1:30 at night there
    first = [(1, at, "move"), (1, at + dt.timedelta(minutes=40), "move"), (2, at, "jump")]
    other = lambda h: [(2, at + dt.timedelta(hours=h), "down")]
    before = run(spark, tmp_path, "t", [first, other(3)])
    assert {x[0] for x in told(before)} <= {2}
    after = run(spark, tmp_path, "t", [other(8), other(9)])
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    assert (1, "move", micros(at + dt.timedelta(minutes=40)), micros(dt.datetime(2024, 3, 2, 1, 30))) in told(after)
    assert after.where("k = 1").count() == 1
