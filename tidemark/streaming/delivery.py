"""Delivery of alerts: quiet hours with a queue that timers release, stamps for each trigger, a common cap, and two sinks.

An alert is a row (key, time, trigger). In quiet hours it waits, the latest of each trigger only, and is released at their end unless it is then older
than `expiry_hours`; triggers that bypass them go out at once. Whether an alert that is due goes out depends on its trigger's policy:

* daily: once for each local day of delivery;
* once: once ever;
* cooldown: not within `hours` after the trigger's last delivery, and not if `cap` deliveries of such triggers lie in the 24 hours before.

`delivered` is the plan for a finished table. `delivered_stream` is the same rule as a keyed stateful operator: rows are held until the watermark has
passed them, so the order of arrival within it does not matter, and an event-time timer releases a queue without any new row of its key. State for a
key is its queue, one stamp for each trigger, at most `cap` recent deliveries and the rows that the watermark has not passed.

Rows with a null key, time or trigger, or with a trigger that has no policy, are not alerts. Alerts alike in key, time and trigger are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    kind: str  # daily, once or cooldown
    hours: float = 24
    bypass: bool = False  # of quiet hours
    public: bool = False  # on the list of what may be sent; anything else goes to the operations log


@dataclass(frozen=True)
class Rules:
    policies: dict[str, Policy] = field(default_factory=dict)
    quiet: tuple[int, int] = (22, 7)  # local hours
    expiry_hours: float = 12
    cap: int = 3
    shift_minutes: int = 330  # local time less UTC

    def of(self, what) -> list[str]:
        return [t for t, p in self.policies.items() if what(p)]

    def release(self, at: int) -> int | None:
        """End of the quiet hours that `at` lies in; None outside them."""
        local = at + self.shift_minutes * 60_000_000
        hour, (a, b) = local % DAY // HOUR, self.quiet
        if not (hour >= a or hour < b if a > b else a <= hour < b):
            return None
        end = local - local % DAY + b * HOUR
        return (end if end > local else end + DAY) - self.shift_minutes * 60_000_000

    def local_day(self, at: int) -> int:
        return (at + self.shift_minutes * 60_000_000) // DAY


def in_sets(column: str, names: list[str]) -> Column:
    return F.col(column).isin(names) if names else F.lit(False)


def due(alerts: DataFrame, key: str, ts: str, trigger: str, rules: Rules) -> DataFrame:
    """(key, trigger, raised, due): when each alert could go out, after the queue has kept the latest of each trigger; microseconds."""
    shift, (a, b) = rules.shift_minutes * 60_000_000, rules.quiet
    d = alerts.select(key, F.col(trigger).alias("trigger"), F.unix_micros(F.col(ts).cast("timestamp")).alias("raised"))
    d = d.where(F.col(key).isNotNull() & F.col("raised").isNotNull() & in_sets("trigger", list(rules.policies))).distinct()
    local = F.col("raised") + shift
    hour, start = F.floor(F.pmod(local, F.lit(DAY)) / HOUR), local - F.pmod(local, F.lit(DAY))
    quiet = ((hour >= a) | (hour < b) if a > b else (hour >= a) & (hour < b)) & ~in_sets("trigger", rules.of(lambda p: p.bypass))
    end = start + b * HOUR
    d = d.withColumn("due", F.when(quiet, F.when(end > local, end).otherwise(end + DAY) - shift))
    held = d.where("due is not null").groupBy(key, "trigger", "due").agg(F.max("raised").alias("raised")).where(F.col("due") - F.col("raised") <= int(rules.expiry_hours * HOUR))
    return d.where("due is null").withColumn("due", F.col("raised")).unionByName(held)


def delivered(alerts: DataFrame, key: str, ts: str, trigger: str, rules: Rules) -> DataFrame:
    """(key, trigger, raised_at, sent_at, sink) of a finished table. Stamps are windows; only what the common cap counts is judged in turn, key by key."""
    d = due(alerts, key, ts, trigger, rules)
    first = lambda *by: F.row_number().over(Window.partitionBy(key, "trigger", *by).orderBy("due", "raised"))
    daily = d.where(in_sets("trigger", rules.of(lambda p: p.kind == "daily"))).withColumn("day", F.floor((F.col("due") + rules.shift_minutes * 60_000_000) / DAY)).withColumn("r", first("day")).where("r = 1").drop("day", "r")
    once = d.where(in_sets("trigger", rules.of(lambda p: p.kind == "once"))).withColumn("r", first()).where("r = 1").drop("r")
    kind = f"{key} {alerts.schema[key].dataType.simpleString()}, trigger string, raised long, due long"

    def in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["due", "raised", "trigger"])
        last: dict[str, int] = {}
        recent: list[int] = []
        kept = []
        for trigger_, at in zip(pdf["trigger"], pdf["due"]):
            recent = [s for s in recent if s > at - DAY]
            ok = len(recent) < rules.cap and (trigger_ not in last or last[trigger_] <= at - rules.policies[trigger_].hours * HOUR)
            if ok:
                last[trigger_] = at
                recent.append(at)
            kept.append(ok)
        return pdf[kept]

    capped = d.where(in_sets("trigger", rules.of(lambda p: p.kind == "cooldown"))).groupBy(key).applyInPandas(in_turn, kind)
    return described(daily.unionByName(once).unionByName(capped), key, rules)


def described(d: DataFrame, key: str, rules: Rules) -> DataFrame:
    sink = F.when(in_sets("trigger", rules.of(lambda p: p.public)), "public").otherwise("operations")
    return d.select(key, "trigger", F.timestamp_micros("raised").alias("raised_at"), F.timestamp_micros("due").alias("sent_at"), sink.alias("sink"))


class Delivery(StatefulProcessor):
    """The rule for one key; see the module. Times are microseconds, timers milliseconds."""

    def __init__(self, key: str, rules: Rules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "raised long, trigger string")
        self.queue = handle.getMapState("queue", "trigger string", "raised long, due long")
        self.sent = handle.getMapState("sent", "trigger string", "at long")
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for raised, trigger in zip(pdf["raised"], pdf["trigger"]):
                self.pending.appendValue((int(raised), trigger))
        yield from self.passed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.passed(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def passed(self, key: Any, until_ms: int) -> Iterator[pd.DataFrame]:
        """Judge all that lies at or before the watermark, in order of time, and set the timer for what comes next."""
        until, rules = until_ms * 1000, self.rules
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        now, later = sorted({r for r in held if r[0] <= until}), [r for r in held if r[0] > until]
        queue = {k[0]: tuple(v) for k, v in self.queue.iterator()} if self.queue.exists() else {}
        was = dict(queue)
        steps = []  # (due, raised, trigger) of what may go out
        for raised, trigger in now:
            release = None if rules.policies[trigger].bypass else rules.release(raised)
            if trigger in queue and queue[trigger][1] <= (raised if release is None else release - 1):  # the earlier window's alert is due first
                steps.append((queue[trigger][1], queue[trigger][0], trigger))
                del queue[trigger]
            if release is None:
                steps.append((raised, raised, trigger))
            else:
                queue[trigger] = (raised, release)
        for trigger in [t for t, (_, at) in queue.items() if at <= until]:
            raised, at = queue.pop(trigger)
            steps.append((at, raised, trigger))
        out = list(self.judged(sorted(steps)))
        if now:
            self.pending.put(later) if later else self.pending.clear()
        for trigger in was.keys() - queue.keys():
            self.queue.removeKey((trigger,))
        for trigger, value in queue.items():
            if was.get(trigger) != value:
                self.queue.updateValue((trigger,), value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        coming = [r[0] for r in later] + [at for _, at in queue.values()]
        if coming:
            self.handle.registerTimer(max(-(-min(coming) // 1000), until_ms + 1))
        if out:
            yield pd.DataFrame([[key[0], t, r, a] for a, r, t in out], columns=[self.key, "trigger", "raised", "due"])

    def judged(self, steps: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        before = list(recent)
        for at, raised, trigger in steps:
            p = self.rules.policies[trigger]
            if at - raised > self.rules.expiry_hours * HOUR and at != raised:
                continue
            last = self.sent.getValue((trigger,))[0] if self.sent.containsKey((trigger,)) else None
            if p.kind == "cooldown":
                recent = [s for s in recent if s > at - DAY]
                ok = len(recent) < self.rules.cap and (last is None or last <= at - p.hours * HOUR)
            else:
                ok = last is None or p.kind == "daily" and self.rules.local_day(last) != self.rules.local_day(at)
            if ok:
                self.sent.updateValue((trigger,), (at,))
                if p.kind == "cooldown":
                    recent.append(at)
                yield at, raised, trigger
        if recent != before:
            self.recent.put([(s,) for s in recent]) if recent else self.recent.clear()

    def close(self) -> None:
        pass


def delivered_stream(stream: DataFrame, key: str, ts: str, trigger: str, rules: Rules, late: str = "1 hour") -> DataFrame:
    """The rule over a stream. Sets the session's state store to RocksDB, which timers need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    d = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & in_sets(trigger, list(rules.policies)))
    d = d.select(key, F.col(ts).cast("timestamp").alias("ts"), F.col(trigger).alias("trigger")).withColumn("raised", F.unix_micros("ts")).withWatermark("ts", late)
    kind = f"{key} {stream.schema[key].dataType.simpleString()}, trigger string, raised long, due long"
    out = d.groupBy(key).transformWithStateInPandas(statefulProcessor=Delivery(key, rules), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    return described(out, key, rules)


def to_sinks(spark: SparkSession, messages: DataFrame, key: str, at: str) -> None:
    """Append messages to the tables of their sinks, `at`/sink=public and `at`/sink=operations; one that is there already adds nothing."""
    from tidemark.sources.stores import append_new

    for sink in ("public", "operations"):
        append_new(spark, messages.where(F.col("sink") == sink).drop("sink"), f"{at.rstrip('/')}/sink={sink}", [key, "trigger", "sent_at"])


def deliver_batches(messages: DataFrame, key: str, at: str, checkpoint: str):
    """Write a stream's messages to their sinks; a batch that is run again after a crash adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        to_sinks(batch.sparkSession, batch, key, at)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
