"""Evaluators of whole sources: every row against its own fields, the states of the rows before it, other sources and the clock.

Each gives findings (source, place, field, code, severity). The checks of a row are one array column and one explode, whatever their number; a check gives its
first case that holds. States of earlier rows come from `hot.states_before`, so one series may hold all rows; what concerns a source as a whole (newest value,
no rows, an absent part) is one aggregate. A check whose input is null does not fire unless it asks for null.
`series`: rows follow each other (else each is judged alone). `live`: the newest value must be fresh. A missing column is a finding, and rows are then not read.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.hot import ROWS, states_before
from tidemark.operators.quality import BLOCK, SEVERITY, WARN

FINDINGS = "source string, place string, field string, code string, severity int"
LEAST_YEAR = 2020


class Range(NamedTuple):
    """Impossible outside low..high, unusual outside warn_low..warn_high."""

    low: float
    high: float
    warn_low: float | None = None
    warn_high: float | None = None


class Pair(NamedTuple):
    """a / b against what it should be, with relative tolerances."""

    a: str
    b: str
    expected: float
    warn: float
    block: float


class Steps(NamedTuple):
    """Limits of one absolute log step."""

    warn: float
    block: float


def check(field: str, *cases: tuple[str, int, Column]) -> Column:
    """(field, code, severity) of the first case that holds, else null."""
    out = None
    for code, severity, cond in cases:
        found = F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
        out = F.when(cond, found) if out is None else out.when(cond, found)
    return out


def findings(df: DataFrame, source: str, place: Column, checks: list[Column]) -> DataFrame:
    d = df.select(place.cast("string").alias("place"), F.explode(F.array_compact(F.array(*checks))).alias("c"))
    return d.select(F.lit(source).alias("source"), "place", "c.field", "c.code", "c.severity")


def _stated(df: DataFrame, source: str, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame([(source, *r) for r in rows], FINDINGS)


def missing(df: DataFrame, source: str, columns: list[str]) -> DataFrame | None:
    gone = [c for c in columns if c not in df.columns]
    return _stated(df, source, [(None, c, "SCHEMA_MISSING_FIELD", BLOCK) for c in gone]) if gone else None


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def instant(df: DataFrame, c: str) -> Column:
    """The moment in a column of text or times; null where it is none. Numbers are no moments: their unit is unknown."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.col(c))
    return F.col(c).cast("timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(None).cast("timestamp")


def zoned(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    return F.col(c).rlike(r"\d(Z|[+-]\d\d:?\d\d)\s*$") if isinstance(kind, T.StringType) else F.lit(isinstance(kind, T.TimestampType))


def sound(t: Column, aware: Column, least_year: int = LEAST_YEAR) -> Column:
    """The moment if it has a zone and is no placeholder."""
    return F.when(aware & (F.year(t) >= least_year), t)


def moment_checks(df: DataFrame, c: str, now: Column, before: Column | None = None, strictly: bool = False, future: str = "5 MINUTES", least_year: int = LEAST_YEAR, zone: bool = True) -> list[Column]:
    t, placeholder = instant(df, c), F.year(instant(df, c)) < least_year
    out = [check(c, ("TS_UNPARSEABLE", BLOCK, t.isNull()), ("TS_EPOCH_PLACEHOLDER", BLOCK, placeholder), ("TS_FUTURE", BLOCK, t > now + F.expr(f"INTERVAL {future}")))]
    if zone:
        out.append(check(c, ("TS_NAIVE", BLOCK, t.isNotNull() & ~zoned(df, c))))
    if before is not None:
        out.append(check(c, ("TS_NOT_AFTER_PREVIOUS", BLOCK, ~placeholder & ((t <= before) if strictly else (t < before)))))
    return out


def number(df: DataFrame, c: str) -> Column:
    """The column as a double if it holds numbers, else null."""
    return F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None).cast("double")


def number_check(x: Column, field: str, limits: Range) -> Column:
    """Not a number, not finite, not positive, off by ten, impossible, unusual: the first that holds."""
    low, high, warn_low, warn_high = limits
    out = ~x.between(low, high)
    cases = [("VALUE_NOT_NUMERIC", BLOCK, x.isNull()), ("VALUE_NOT_FINITE", BLOCK, F.isnan(x) | (F.abs(x) == float("inf"))), ("VALUE_NON_POSITIVE", BLOCK, x <= 0),
             ("UNIT_SUSPECT_PER_10G", BLOCK, out & (x / 10).between(low, high)), ("UNIT_SUSPECT_PER_G", BLOCK, out & (x * 10).between(low, high)), ("VALUE_OUT_OF_RANGE", BLOCK, out)]
    unusual = [c for c in (None if warn_low is None else x < warn_low, None if warn_high is None else x > warn_high) if c is not None]
    return check(field, *cases, *[("VALUE_OUTSIDE_HISTORY", WARN, u) for u in unusual])


def good(x: Column, limits: Range) -> Column:
    """x where it is possible."""
    return F.when(x.between(limits.low, limits.high), x)


def pair_check(a: Column, b: Column, p: Pair) -> Column:
    off = F.abs(a / b / p.expected - 1)
    return check(f"{p.a}/{p.b}", ("RATIO_BLOCK", BLOCK, off > p.block), ("RATIO_WARN", WARN, off > p.warn))


def step_check(field: str, x: Column, before: Column, limits: Steps, days: Column | None = None) -> Column:
    """The log step from the value before, over the root of the days between where they are given (one at least)."""
    m = F.abs(F.ln(x / before))
    m = m if days is None else m / F.sqrt(F.greatest(days, F.lit(1.0)))
    fit = (x > 0) & (before > 0)
    return check(field, ("JUMP_BLOCK", BLOCK, fit & (m > limits.block)), ("JUMP_WARN", WARN, fit & (m > limits.warn)))


def limit_check(field: str, kind: str, x: Column, warn: float, block: float) -> Column:
    return check(field, (f"{kind}_BLOCK", BLOCK, x > block), (f"{kind}_WARN", WARN, x > warn))


def hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def working_days(a: Column, b: Column) -> Column:
    """Days from Monday to Friday after a, up to b."""
    def until(d):
        n = F.datediff(d, F.lit(dt.date(1970, 1, 5)))  # a Monday
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4))

    return until(b) - until(a)


def repeated(key: list[str], order: list[str]) -> Column:
    """True on each row whose key occurred before."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1


def whole(df: DataFrame, source: str, newest: Column, now: Column, warn_h: float, block_h: float, live: bool, age: Column | None = None) -> DataFrame:
    """No rows, no usable moment, or a newest one that is too old."""
    d = df.agg(F.count(F.lit(1)).alias("n"), F.max(newest).alias("newest"))
    old = hours(now, F.col("newest")) if age is None else age
    cases = [("EMPTY_SOURCE", BLOCK, F.col("n") == 0)]
    if live:
        cases += [("TS_UNPARSEABLE", BLOCK, F.col("newest").isNull()), ("STALE_BLOCK", BLOCK, old > block_h), ("STALE_WARN", WARN, old > warn_h)]
    return findings(d, source, F.lit(None), [check("newest", *cases)])


def readings(df: DataFrame, now: Column, by: list[str], position: str, at: str, rates: dict[str, Range], pairs: list[Pair], label: str, moved: str, steps: Steps, gap: tuple[float, float] = (48.0, 168.0), series: bool = True, live: bool = True, name: str = "readings", rows: int = ROWS) -> DataFrame:
    """Price readings in order of arrival: moments strictly ascending, rates and their ratios, a label, steps and gaps. Ratios are judged where both rates pass."""
    if (gone := missing(df, name, [*by, position, at, label, *rates])) is not None:
        return gone
    t = instant(df, at)
    usable, x = sound(t, zoned(df, at)), {c: number(df, c) for c in rates}
    d = df
    checks = []
    if series:
        d = states_before(df, by, [position], last={"__x": good(x[moved], rates[moved])}, top={"__t": usable}, rows=rows)
        d = d.withColumn("__rep", repeated([*by, at], [position]))
        checks = [check(at, ("DUPLICATE_KEY", BLOCK, F.col("__rep") & t.isNotNull() & zoned(df, at))), step_check(moved, good(x[moved], rates[moved]), F.col("__x"), steps),
                  limit_check(at, "GAP", F.when(zoned(df, at), hours(t, F.col("__t"))), *gap)]
    own = {c: F.when(x[c].between(r.warn_low if r.warn_low is not None else r.low, r.warn_high if r.warn_high is not None else r.high), x[c]) for c, r in rates.items()}
    checks += moment_checks(df, at, now, F.col("__t") if series else None, strictly=True)
    checks += [number_check(x[c], c, r) for c, r in rates.items()] + [pair_check(own[p.a], own[p.b], p) for p in pairs]
    checks.append(check(label, ("SCHEMA_BAD_TYPE", BLOCK, F.col(label).isNull() | (F.trim(F.col(label).cast("string")) == ""))))
    return together([findings(d, name, F.col(position), checks), whole(df, name, usable, now, *gap, live)])


def outcomes(df: DataFrame, now: Column, by: list[str], position: str, at: str, outcome: str, known: list[str], flag: str | None = None, gap: tuple[float, float] = (48.0, 168.0), series: bool = True, live: bool = True, name: str = "outcomes", rows: int = ROWS) -> DataFrame:
    """Results of attempts: moments not descending, known outcomes only, a flag that is true, false or null."""
    if (gone := missing(df, name, [*by, position, at, outcome])) is not None:
        return gone
    t = instant(df, at)
    usable = sound(t, zoned(df, at))
    checks = [check(outcome, ("SCHEMA_UNKNOWN_VALUE", WARN, F.col(outcome).isNull() | ~F.col(outcome).isin(known)))]
    if flag in df.columns and not isinstance(df.schema[flag].dataType, T.BooleanType):
        checks.append(check(flag, ("SCHEMA_BAD_TYPE", WARN, ~F.col(flag).cast("string").isin("true", "false"))))
    d = df
    if series:
        d = states_before(df, by, [position], top={"__t": usable}, rows=rows).withColumn("__rep", repeated([*by, at], [position]))
        checks += [check(at, ("DUPLICATE_KEY", BLOCK, F.col("__rep") & usable.isNotNull())), limit_check(at, "GAP", hours(usable, F.col("__t")), *gap)]
    checks += moment_checks(df, at, now, F.col("__t") if series else None)
    return together([findings(d, name, F.col(position), checks), whole(df, name, usable, now, *gap, live)])


def fixes(df: DataFrame, now: Column, by: list[str], position: str, day: str, fetched: str, morning: dict[str, Range], evening: dict[str, Range], pairs: list[Pair], base: tuple[str, str], half_day: tuple[float, float], steps: Steps, gap: tuple[int, int] = (3, 7), live_from: str | None = None, zone: str = "UTC", least_year: int = LEAST_YEAR, series: bool = True, live: bool = True, name: str = "fixes", rows: int = ROWS) -> DataFrame:
    """Fixes of the morning and the evening, one row a day: null mornings block, null evenings only warn and never in the newest row by position.

    `base` names the column of each half. Steps and gaps compare with the row of the day before it in the order of days; gaps count working days.
    """
    if (gone := missing(df, name, [*by, position, day, fetched, *morning, *evening])) is not None:
        return gone
    limits = {**morning, **evening}
    x = {c: number(df, c) for c in limits}
    ok = {c: good(x[c], r) for c, r in limits.items()}
    date = F.try_to_date(F.col(day).cast("string"), "yyyy-MM-dd")
    here = F.to_date(F.from_utc_timestamp(now, zone))
    d = df.withColumns({"__d": date, "__ref": F.coalesce(ok[base[1]], ok[base[0]]), "__raw": F.coalesce(x[base[1]], x[base[0]])})
    newest = F.max(position).over(Window.partitionBy(*by)) == F.col(position)
    d = d.withColumn("__end", newest)
    checks = [check(day, ("TS_UNPARSEABLE", BLOCK, F.col("__d").isNull()), ("TS_EPOCH_PLACEHOLDER", BLOCK, F.year("__d") < least_year), ("TS_FUTURE", BLOCK, F.col("__d") > F.date_add(here, 1)))]
    there = F.col("__d").isNotNull()
    inner = [c for c in moment_checks(df, fetched, now, least_year=least_year)]
    inner += [F.when(x[c].isNotNull(), number_check(x[c], c, r)) for c, r in limits.items()]
    inner.append(check("morning", ("NULL_VALUE", BLOCK, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in morning]))))
    inner.append(check("evening", ("NULL_VALUE", WARN, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in evening]) & ~F.col("__end"))))
    inner += [pair_check(ok[p.a], ok[p.b], p) for p in pairs]
    inner.append(limit_check(f"{base[1]}/{base[0]}", "RATIO", F.abs(ok[base[1]] / ok[base[0]] - 1), *half_day))
    if series:
        d = states_before(d, by, [position], top={"__latest": F.col("__d")}, rows=rows)
        d = states_before(d.withColumn("__rep", repeated([*by, "__d"], [position])), by, ["__d", position], last={"__before": F.when(there, F.struct("__d", "__raw"))}, rows=rows)
        pd, pv = F.col("__before")["__d"], F.col("__before")["__raw"]
        inner += [check(day, ("DUPLICATE_KEY", BLOCK, F.col("__rep"))), check(day, ("TS_ORDER", WARN, F.col("__d") < F.col("__latest")))]
        inner.append(step_check(base[1], F.col("__ref"), pv, steps, F.datediff("__d", pd)))
        begun = F.lit(True) if live_from is None else pd >= F.lit(live_from).cast("date")
        inner.append(limit_check(day, "GAP", F.when(begun & F.col("__ref").isNotNull() & pv.isNotNull() & (pd < F.col("__d")), working_days(pd, F.col("__d"))), *gap))
    checks += [F.when(there, c) for c in inner]
    age = working_days(F.col("newest"), here)
    return together([findings(d, name, F.col(position), checks), whole(df, name, date, now, *gap, live, age)])


def snapshots(df: DataFrame, now: Column, position: str, captured: str, observed: str, part: str, city: str, rate: str, limits: Range, steps: Steps, national: list[str], regional: dict[str, list[str]], observed_age: dict[str, tuple[float, float]], spread: tuple[float, float], gap: tuple[float, float] = (24.0, 72.0), texts: tuple[str, ...] = (), least_year: int = LEAST_YEAR, series: bool = True, live: bool = True, name: str = "snapshots", rows: int = ROWS) -> DataFrame:
    """Captures of several parts: known parts and cities, ages of observations, steps of each (part, city), parts of one capture against each other, absent parts.

    Rows with an impossible rate or observation take no part in steps, spreads and newest values.
    """
    if (gone := missing(df, name, [position, captured, observed, part, city, rate, *texts])) is not None:
        return gone
    x, cap, obs = number(df, rate), instant(df, captured), sound(instant(df, observed), zoned(df, observed), least_year)
    parts = [*national, *regional]
    registered = [(F.col(part) == p) & F.col(city).isin(c) for p, c in regional.items()]
    fits = F.when(F.col(part).isin(national), F.col(city).isNull()).otherwise(F.coalesce(reduce(lambda a, b: a | b, registered, F.lit(False)), F.lit(False)))
    d = df.withColumns({"__cap": cap, "__ok": F.when(cap.isNotNull() & obs.isNotNull(), good(x, limits))})
    checks = moment_checks(df, captured, now, least_year=least_year) + moment_checks(df, observed, F.coalesce(cap, now), least_year=least_year)
    checks += [number_check(x, rate, limits), check(part, ("SCHEMA_UNKNOWN_VALUE", BLOCK, F.col(part).isNull() | ~F.col(part).isin(parts))), check(city, ("SCHEMA_UNKNOWN_VALUE", BLOCK, F.col(part).isin(parts) & ~fits))]
    checks += [check(c, ("SCHEMA_BAD_TYPE", BLOCK, F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))) for c in texts]
    checks += [F.when(F.col(part) == p, limit_check(observed, "STALE", hours(cap, obs), *age)) for p, age in observed_age.items()]
    out = []
    if series:
        d = states_before(d.withColumn("__all", F.lit(0)), ["__all"], [position], top={"__latest": F.col("__cap")}, rows=rows)
        d = states_before(d, [part, city], ["__cap", position], last={"__x": F.col("__ok")}, rows=rows).withColumn("__rep", repeated([captured, part, city], [position]))
        checks += [check(captured, ("DUPLICATE_KEY", BLOCK, F.col("__rep"))), check(captured, ("TS_ORDER", WARN, F.col("__cap") < F.col("__latest"))), step_check(rate, F.col("__ok"), F.col("__x"), steps)]
        one = d.where(F.col("__ok").isNotNull() & F.col(city).isNull() & F.col(part).isin(national)).groupBy("__cap", part).agg(F.max_by("__ok", position).alias("v"))
        both = one.groupBy("__cap").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("hi"), F.min("v").alias("lo")).where("n > 1")
        out.append(findings(both, name, F.col("__cap"), [limit_check("parts", "CROSS_SOURCE", (F.col("hi") - F.col("lo")) / ((F.col("hi") + F.col("lo")) / 2), *spread)]))
    if live:
        named = df.sparkSession.createDataFrame([(p,) for p in parts], "part string")
        newest = d.where(F.col("__ok").isNotNull()).groupBy(F.col(part).alias("part")).agg(F.max("__cap").alias("newest"))
        old = hours(now, F.col("newest"))
        out.append(findings(F.broadcast(named).join(newest, "part", "left"), name, F.col("part"), [check("newest", ("STALE_BLOCK", BLOCK, F.col("newest").isNull() | (old > gap[1])), ("STALE_WARN", WARN, old > gap[0]))]))
    return together([findings(d, name, F.col(position), checks), whole(df, name, cap, now, *gap, False), *out])


def fused_outputs(df: DataFrame, now: Column, position: str, captured: str, day: str, value: str, half_width: str, used: str, limits: Range, failures: list[str], cities: str | None = None, widest: float = 0.1, gap: tuple[float, float] = (12.0, 48.0), least_year: int = LEAST_YEAR, live: bool = True, name: str = "fused_outputs") -> DataFrame:
    """States a fusion wrote: value with half width and the parts it used, values of cities (a map), failures that parts reported (maps from part to text)."""
    if (gone := missing(df, name, [position, captured, day, value, half_width, used, *failures])) is not None:
        return gone
    x, h = number(df, value), number(df, half_width)
    valid = F.coalesce((h >= 0) & (h < float("inf")) & ~F.isnan(h), F.lit(False))
    there = F.col(value).isNotNull()
    passed = x.between(limits.low if limits.warn_low is None else limits.warn_low, limits.high if limits.warn_high is None else limits.warn_high)
    checks = moment_checks(df, captured, now, least_year=least_year)
    checks += [check(day, ("TS_UNPARSEABLE", BLOCK, F.to_date(instant(df, day)).isNull())), check(value, ("NULL_VALUE", WARN, ~there)), F.when(there, number_check(x, value, limits)),
               F.when(there, check(half_width, ("VALUE_NOT_NUMERIC", BLOCK, ~(passed & valid)), ("VALUE_OUT_OF_RANGE", WARN, h > widest * x))),
               F.when(there, check(used, ("SCHEMA_BAD_TYPE", BLOCK, F.coalesce(F.size(used), F.lit(0)) < 1)))]
    out = [findings(df, name, F.col(position), checks), whole(df, name, sound(instant(df, captured), zoned(df, captured), least_year), now, *gap, live)]
    if cities and cities in df.columns:
        c = df.select(F.col(position).alias("__p"), F.explode(cities).alias("city", "v"))
        out.append(findings(c, name, F.concat_ws(":", F.col("__p").cast("string"), "city"), [number_check(F.col("v").cast("double"), "city", limits)]))
    for f in failures:
        c = df.select(F.col(position).alias("__p"), F.explode(f).alias("part", "why"))
        out.append(findings(c, name, F.concat_ws(":", F.col("__p").cast("string"), "part"), [check(f, ("SOURCE_REPORTED_FAILURE", WARN, F.lit(True)))]))
    return together(out)


def feature_store(df: DataFrame, now: Column, position: str, captured: str, day: str, part: str, values: dict[str, Range], core: list[str], steps: dict[str, Steps], version: str | None = None, dated_from: int = 3, most_lag: int = 6, band: tuple[str, str, float, tuple[float, float], tuple[float, float]] | None = None, live_part: str = "live", gap: tuple[float, float] = (120.0, 240.0), least_year: int = LEAST_YEAR, series: bool = True, live: bool = True, name: str = "feature_store", rows: int = ROWS) -> DataFrame:
    """Wide rows of one (part, day): each value <c> with <c>_asof_date, which must not be after the day nor more than `most_lag` days before it.

    Core values must not be null. Rows of a `version` before `dated_from` may lack the date. band: (a, b, scale, (warn low, high), (block low, high)) of a / (b / scale).
    """
    if (gone := missing(df, name, [position, captured, day, part, *values, *[f"{c}_asof_date" for c in values]])) is not None:
        return gone
    asof, x = F.to_date(instant(df, day)), {c: number(df, c) for c in values}
    checks = moment_checks(df, captured, now, least_year=least_year)
    inner = []
    for c, r in values.items():
        own = F.to_date(instant(df, f"{c}_asof_date"))
        legacy = (F.col(f"{c}_asof_date").isNull() & (F.col(version) < dated_from)) if version else F.lit(False)
        if c in core:
            inner.append(check(c, ("NULL_VALUE", BLOCK, F.col(c).isNull())))
        there = F.col(c).isNotNull()
        inner.append(F.when(there, number_check(x[c], c, r)))
        inner.append(F.when(there, check(f"{c}_asof_date", ("SCHEMA_MISSING_FIELD", WARN, legacy), ("TS_UNPARSEABLE", BLOCK, own.isNull()), ("TS_FUTURE", BLOCK, own > asof), ("STALE_WARN", WARN, F.datediff(asof, own) > most_lag))))
    if band:
        a, b, scale, warn, block = band
        q = x[a] / F.when(x[b] > 0, x[b] / scale)
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        inner.append(F.when(both, check(f"{a}/{b}", ("VALUE_NOT_FINITE", BLOCK, q.isNull() | F.isnan(q) | (F.abs(q) == float("inf"))), ("CROSS_SOURCE_BLOCK", BLOCK, ~q.between(*block)), ("CROSS_SOURCE_WARN", WARN, ~q.between(*warn)))))
    d = df.withColumn("__d", asof)
    if series:
        fit = {c: F.when((x[c] > 0) & (x[c] < float("inf")) & F.col("__d").isNotNull(), F.struct(F.col("__d").alias("d"), x[c].alias("v"))) for c in steps}
        d = states_before(d, [part], ["__d", position], last={f"__b_{c}": s for c, s in fit.items()}, rows=rows).withColumn("__rep", repeated([part, day], [position]))
        inner.append(check(day, ("DUPLICATE_KEY", BLOCK, F.col("__rep"))))
        for c, s in steps.items():
            b = F.col(f"__b_{c}")
            inner.append(step_check(c, F.when((F.col("__d") > b["d"]) & (x[c] < float("inf")), x[c]), b["v"], s, F.datediff("__d", b["d"])))
    checks += [check(day, ("TS_UNPARSEABLE", BLOCK, asof.isNull()), ("TS_EPOCH_PLACEHOLDER", BLOCK, F.year(asof) < least_year))] + [F.when(F.col("__d").isNotNull(), c) for c in inner]
    out = [findings(d, name, F.col(position), checks), whole(df, name, asof, now, *gap, False)]
    if live:
        newest = df.agg(F.max(F.when((F.col(part) == live_part) & asof.isNotNull(), sound(instant(df, captured), zoned(df, captured), least_year))).alias("newest"))
        old = hours(now, F.col("newest"))
        out.append(findings(newest, name, F.lit(live_part), [check("newest", ("STALE_BLOCK", BLOCK, F.col("newest").isNull() | (old > gap[1])), ("STALE_WARN", WARN, old > gap[0]))]))
    return together(out)


def frame(df: DataFrame, now: Column, position: str, at: str, values: dict[str, Range], steps: dict[str, Steps], core: list[str] = (), by_root_day: bool = True, future: str = "1 DAYS", gap: tuple[float, float] = (120.0, 336.0), least_year: int = LEAST_YEAR, series: bool = True, live: bool = True, name: str = "frame", rows: int = ROWS) -> DataFrame:
    """A wide frame of series by time: each value's step from its last possible one; order and repeats of times are judged for the frame as a whole."""
    if (gone := missing(df, name, [position, at, *values])) is not None:
        return gone
    t, x = instant(df, at), {c: number(df, c) for c in values}
    checks = moment_checks(df, at, now, future=future, least_year=least_year, zone=False)
    for c, r in values.items():
        checks.append(check(c, ("NULL_VALUE", WARN, F.lit(c in core) & F.col(c).isNull())))
        checks.append(F.when(F.col(c).isNotNull(), number_check(x[c], c, r)))
    out = [whole(df, name, t, now, *gap, live)]
    if isinstance(df.schema[at].dataType, T.TimestampNTZType):
        out.append(_stated(df, name, [(None, at, "TS_NAIVE", BLOCK)]))
    d = df
    if series:
        d = df.withColumns({"__all": F.lit(0), "__t": t})
        fit = {f"__b_{c}": F.when(good(x[c], values[c]).isNotNull(), F.struct(F.col("__t").alias("t"), x[c].alias("v"))) for c in steps}
        d = states_before(d, ["__all"], [position], last=fit, top={"__latest": F.col("__t")}, rows=rows)
        for c, s in steps.items():
            b = F.col(f"__b_{c}")
            checks.append(step_check(c, F.when(F.col("__t") > b["t"], good(x[c], values[c])), b["v"], s, hours(F.col("__t"), b["t"]) / 24 if by_root_day else None))
        order = d.agg(F.max(F.coalesce(F.col("__t") < F.col("__latest"), F.lit(False))).alias("bad"))
        again = df.where(t.isNotNull()).groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        out += [findings(order, name, F.lit(None), [check(at, ("TS_ORDER", WARN, F.col("bad")))]), findings(again, name, F.lit(None), [check(at, ("DUPLICATE_KEY", BLOCK, F.col("n") > 1))])]
    return together([findings(d, name, F.col(position), checks), *out])


def seed(df: DataFrame, now: Column, position: str, day: str, values: list[str], limits: Range, moved: str, steps: Steps, flags: list[str], percent: str | None = None, most_gap: int = 5, least_year: int = 2000, series: bool = True, name: str = "seed", rows: int = ROWS) -> DataFrame:
    """A backfilled daily history: days ascending, values possible, a percentage within 0 to 30, flags that are not null, steps and gaps."""
    if (gone := missing(df, name, [position, day, *values, *flags])) is not None:
        return gone
    t = instant(df, day)
    checks = moment_checks(df, day, now, least_year=least_year, zone=False)
    checks += [number_check(number(df, c), c, limits) for c in values]
    for f in flags:
        checks.append(check(f, ("SCHEMA_BAD_TYPE", BLOCK, F.col(f).isNull() | F.lit(not isinstance(df.schema[f].dataType, T.BooleanType)))))
    if percent and percent in df.columns:
        p = number(df, percent)
        checks.append(check(percent, ("VALUE_OUT_OF_RANGE", BLOCK, ~F.coalesce(p.between(0, 30), F.lit(False)))))
    d, out = df, []
    if series:
        m = number(df, moved)
        d = df.withColumns({"__all": F.lit(0), "__t": t})
        fit = F.when((m > 0) & (m < float("inf")), m)
        d = states_before(d, ["__all"], [position], last={"__x": fit, "__pt": F.col("__t")}, top={"__latest": F.col("__t")}, rows=rows)
        days = F.floor(hours(F.col("__t"), F.col("__pt")) / 24)
        checks += [step_check(moved, fit, F.col("__x"), steps), check(day, ("GAP_WARN", WARN, fit.isNotNull() & F.col("__x").isNotNull() & (days > most_gap)))]
        order = d.agg(F.max(F.coalesce(F.col("__t") < F.col("__latest"), F.lit(False))).alias("bad"))
        again = df.where(t.isNotNull()).groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        out = [findings(order, name, F.lit(None), [check(day, ("TS_ORDER", BLOCK, F.col("bad")))]), findings(again, name, F.lit(None), [check(day, ("DUPLICATE_KEY", BLOCK, F.col("n") > 1))])]
    return together([findings(d, name, F.col(position), checks), whole(df, name, t, now, 0, 0, False), *out])


def two_seeds(a: DataFrame, b: DataFrame, day: str, left: str, right: str, limits: tuple[float, float] = (0.15, 0.30), least_share: float = 0.9, name: str = "seeds") -> DataFrame:
    """Two histories of one thing on their common days; too few common days block."""
    gone = [(None, c, "SCHEMA_MISSING_FIELD", BLOCK) for d, c in ((a, left), (b, right)) if c not in d.columns]
    if gone:
        return _stated(a, name, gone)
    j = a.select(day, F.col(left).cast("double").alias("__a")).join(b.select(day, F.col(right).cast("double").alias("__b")), day)
    off = F.abs(F.col("__a") / F.when(F.col("__b") != 0, F.col("__b")) - 1)
    row = check("values", ("CROSS_SOURCE_BLOCK", BLOCK, off.isNull() | F.isnan(off) | (off > limits[1])), ("CROSS_SOURCE_WARN", WARN, off > limits[0]))
    n = [d.agg(F.count(F.lit(1)).alias(c)) for d, c in ((j, "both"), (a, "l"), (b, "r"))]
    counts = n[0].crossJoin(n[1]).crossJoin(n[2])  # one row each
    return together([findings(j, name, F.col(day), [row]), findings(counts, name, F.lit(None), [check("days", ("CROSS_SOURCE_BLOCK", BLOCK, F.col("both") < least_share * F.least("l", "r")))])])


def reports(found: list[DataFrame], sources: list[str]) -> DataFrame:
    """One row for each source: status (worst severity, ok without findings) and how many of each severity.

    Each evaluator is its own job, so no plan holds all of them; what comes back of one is a row for each source.
    """
    counts = [F.count(F.when(F.col("severity") == i, 1)).alias(f"n_{s}") for i, s in enumerate(SEVERITY)]
    total = {s: [0] * len(SEVERITY) for s in sources}
    for d in found:
        for source, *n in d.groupBy("source").agg(*counts).collect():
            total[source] = [a + b for a, b in zip(total.get(source, [0] * len(n)), n)]
    rows = [(s, next((w for w, k in zip(reversed(SEVERITY), reversed(n)) if k), "ok"), *n) for s, n in total.items()]
    return found[0].sparkSession.createDataFrame(rows, "source string, status string, " + ", ".join(f"n_{s} long" for s in SEVERITY))
