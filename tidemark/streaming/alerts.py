"""Stateful alerts and exactly-once appends on Structured Streaming; the same rules run over a finished table in batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS_HOUR = 3_600_000_000


def append_once(stream: DataFrame, keys: list[str], event_time: str, late: str = "10 days") -> DataFrame:
    """The first row of each business key; late rows within the watermark count, repeats do not."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], better: str, checkpoint: str):
    """Keeps one best row a key at `path`: late and same-day upgrades are merged batch by batch."""
    from tidemark.sources.stores import opened, replace, upgraded

    def merge(batch: DataFrame, _: int) -> None:
        replace(upgraded(opened(batch.sparkSession, path, batch.schema), batch, keys, better), path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def gaps_by_session(stream: DataFrame, key: str, event_time: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of readings no further apart than `gap`: start, end and count; what lies between two is an outage."""
    d = stream.withWatermark(event_time, late)
    return d.groupBy(key, F.session_window(event_time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed(stream: DataFrame, key: str, event_time: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    d = stream.withWatermark(event_time, late)
    return d.groupBy(key, F.window(event_time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def resolve_pending(decisions: DataFrame, outcomes: DataFrame, key: str, decided: str, known: str, within: str) -> DataFrame:
    """Stream-stream interval join: each decision with outcomes known after it within the interval."""
    d = decisions.withWatermark(decided, within).alias("d")
    o = outcomes.withWatermark(known, within).alias("o")
    on = F.expr(f"d.{key} = o.{key} and o.{known} > d.{decided} and o.{known} <= d.{decided} + interval {within}")
    return d.join(o, on)


def move_alerts(df: DataFrame, by: list[str], order: str, value: str, least: float = 150.0) -> DataFrame:
    """Rows that differ from the previous different value by at least `least`."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__p", F.lag(value).over(w)).where("__p is not null").where(F.col(value) != F.col("__p"))
    return d.withColumn("move", F.col(value) - F.col("__p")).where(F.abs("move") >= least).drop("__p")


class Cooldown:
    """Sends an alert unless the same trigger was sent within `hours`, or `most` alerts went out in the last day (all triggers).

    Inside quiet hours alerts wait and the latest of each trigger is sent at their end, unless older than `expiry` hours by then.
    """

    def __init__(self, hours: float = 24, most: int = 3, quiet: tuple[int, int] | None = None, expiry: float = 12, shift_hours: float = 5.5):
        self.hours, self.most, self.quiet, self.expiry, self.shift = hours, most, quiet, expiry, shift_hours

    def is_quiet(self, at: float) -> bool:
        if not self.quiet:
            return False
        h, (a, b) = (at + self.shift) % 24, self.quiet
        return h >= a or h < b if a > b else a <= h < b

    def run(self, alerts: list[tuple[float, str]], sent: list[tuple[float, str]], waiting: dict[str, float], now: float | None = None) -> tuple[list[tuple[float, str, float]], list[tuple[float, str]], dict[str, float]]:
        """alerts: (hour, trigger) in order. Returns what is sent as (hour, trigger, raised), the kept history and the queue."""
        out = []

        def send(at: float, trigger: str, raised: float) -> None:
            recent = [s for s in sent if s[0] > at - 24]
            if len(recent) < self.most and not any(t == trigger and s > at - self.hours for s, t in sent):
                out.append((at, trigger, raised))
                sent.append((at, trigger))

        def release(at: float) -> None:
            if waiting and not self.is_quiet(at):
                for trigger, raised in sorted(waiting.items(), key=lambda x: x[1]):
                    if at - raised <= self.expiry:
                        send(at, trigger, raised)
                waiting.clear()

        for at, trigger in alerts:
            release(at)
            if self.is_quiet(at):
                waiting[trigger] = at
            else:
                send(at, trigger, at)
        if now is not None:
            release(now)
        horizon = max([at for at, _ in alerts], default=now or 0) - max(24, self.hours)
        return out, [s for s in sent if s[0] > horizon], waiting


def cooldown_batch(df: DataFrame, key: str, ts: str, trigger: str, rule: Cooldown) -> DataFrame:
    """The rule over a finished table: key, sent_at (hours since 1970), trigger."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["__h", trigger])
        out, _, _ = rule.run(list(zip(d["__h"], d[trigger])), [], {})
        return pd.DataFrame([[pdf[key].iloc[0], h, t] for h, t, _ in out], columns=[key, "sent_hour", trigger])

    hours = F.unix_micros(F.col(ts).cast("timestamp")) / MICROS_HOUR
    return df.select(key, hours.alias("__h"), trigger).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, sent_hour double, {trigger} string")


def cooldown_stream(stream: DataFrame, key: str, ts: str, trigger: str, rule: Cooldown) -> DataFrame:
    """The same as a keyed stateful operator; state: sent alerts of the last day and the queue."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, names, w_names, w_times = state.get if state.exists else ([], [], [], [])
        rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame({"__h": [], trigger: []})
        rows = rows.sort_values(["__h", trigger])
        out, sent, waiting = rule.run(list(zip(rows["__h"], rows[trigger])), list(zip(times, names)), dict(zip(w_names, w_times)))
        state.update(([s for s, _ in sent], [t for _, t in sent], list(waiting), list(waiting.values())))
        yield pd.DataFrame([[k[0], h, t] for h, t, _ in out], columns=[key, "sent_hour", trigger])

    kind = stream.schema[key].dataType.simpleString()
    hours = F.unix_micros(F.col(ts).cast("timestamp")) / MICROS_HOUR
    d = stream.select(key, hours.alias("__h"), trigger)
    return d.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, sent_hour double, {trigger} string", "times array<double>, names array<string>, w_names array<string>, w_times array<double>", "append", GroupStateTimeout.NoTimeout)


def once_per_day(df: DataFrame, key: list[str], ts: str, tz: str = "Asia/Kolkata") -> DataFrame:
    """The first row of each key and local day."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz))
    d = df.withColumn("local_day", day)
    return d.withColumn("__r", F.row_number().over(Window.partitionBy(*key, "local_day").orderBy(ts))).where("__r = 1").drop("__r")


def failure_streak(df: DataFrame, by: list[str], order: str, ok: Column, least: int = 2) -> DataFrame:
    """Rows with at least `least` failures in a row up to and including them, and the length so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__ok", F.coalesce(ok, F.lit(False)).cast("int")).withColumn("__i", F.sum("__ok").over(w))
    inside = Window.partitionBy(*by, "__i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("streak", F.sum(1 - F.col("__ok")).over(inside)).where(F.col("streak") >= least).drop("__ok", "__i")


def dead_man(last_seen: Column, now: Column, warn_hours: float = 6, escalate_hours: float = 24) -> Column:
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp"))) / MICROS_HOUR
    return F.when(age.isNull(), "never seen").when(age >= escalate_hours, "escalate").when(age >= warn_hours, "warn").otherwise("ok")


def memory_rows(query: Any, spark, name: str) -> DataFrame:
    query.processAllAvailable()
    query.stop()
    return spark.table(name)




def triggers() -> dict[str, Column]:
    """Every alert rule as a condition over a state row; an unknown input does not fire."""
    c = F.col
    t = {
        "momentum_down": c("momentum_7d") <= -c("momentum_limit"),
        "momentum_up": c("momentum_7d") >= c("momentum_limit"),
        "jump": F.abs(c("price") - c("previous_different_price")) >= 150,
        "weekly_digest": ((F.weekday("local_day") == 6) & (c("local_hour") >= 17)) | ((F.weekday("local_day") == 0) & ~c("digest_sent_this_week")),
        "model_degraded": c("probe_failed") | c("model_degraded"),
        "calibration_valid": c("calibration_valid") & ~c("calibration_seen"),
        "alive": c("days_since_alert") >= 3,
        "digest_morning": c("local_hour").between(8, 13),
        "digest_evening": c("local_hour").between(18, 21),
        "benchmark_stale": c("benchmark_business_days").between(2, 3),
        "benchmark_stale_escalated": c("benchmark_business_days") >= 4,
        "no_snapshot": c("snapshot_days") >= 2,
        "no_usable_snapshot": c("usable_snapshot_weekdays") >= 2,
        "last_resort": c("source_tier") == "last_known",
        "job_failures": c("failure_streak") >= 2,
        "reading_stale": c("reading_hours_without_sundays") > 30,
        "benchmark_moved": F.abs(c("fix") - c("previous_fix")) >= 150,
        "model_demoted": c("demoted"),
        "model_changed": c("champion") != c("previous_champion"),
        "coverage_low": c("coverage_alert") & ~c("coverage_alert_sent"),
        "first_look": (c("forward_days") >= 10) & ~c("first_look_sent"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in t.items()}


def fired(state: DataFrame, key: list[str]) -> DataFrame:
    """One row for each state row and trigger that fires."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in triggers().items()]))
    return state.select(*key, F.explode(names).alias("trigger"))
