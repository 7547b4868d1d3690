"""Evaluators of whole sources over the driver's tables: findings of each, and one report for all.

The tables stand in for sources: events for readings and outcomes, the days of orders for fixes, fusions, features and frames, orders for snapshots,
orders and line items for two histories.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import source_checks as C
from tidemark.operators import windows as W
from tidemark.sources.readers import table
from tidemark.suites import query

EVENTS_NOW, ORDERS_NOW = "2024-03-03 12:00:00", "2001-08-06 09:00:00"
PRICE = C.Range(20.0, 450.0, 40.0, 380.0)


def now(text):
    return F.lit(text).cast("timestamp")


def case(field, *cases):
    """A check as SQL: the first case that holds."""
    return "case " + " ".join(f"when {cond} then {{'field': '{field}', 'code': '{code}', 'severity': {sev}}}" for code, sev, cond in cases) + " end"


def num(x, field, r):
    unusual = [c for c in (r.warn_low is not None and f"{x} < {r.warn_low}", r.warn_high is not None and f"{x} > {r.warn_high}") if c]
    possible = f"between {r.low} and {r.high}"
    return case(field, ("VALUE_NOT_NUMERIC", 2, f"{x} is null"), ("VALUE_NON_POSITIVE", 2, f"{x} <= 0"), ("UNIT_SUSPECT_PER_10G", 2, f"{x} not {possible} and {x} / 10 {possible}"), ("UNIT_SUSPECT_PER_G", 2, f"{x} not {possible} and {x} * 10 {possible}"),
                ("VALUE_OUT_OF_RANGE", 2, f"{x} not {possible}"), *[("VALUE_OUTSIDE_HISTORY", 1, u) for u in unusual])


def over(field, kind, x, warn, block):
    return case(field, (f"{kind}_BLOCK", 2, f"{x} > {block}"), (f"{kind}_WARN", 1, f"{x} > {warn}"))


def found(source, rows, place, *checks):
    """Findings of a relation, one for each check that fires."""
    return f"select '{source}' as source, place, c.field as field, c.code as code, c.severity as severity from (select cast({place} as varchar) as place, unnest([{', '.join(checks)}]) as c from {rows}) where c is not null"


def stale(source, rows, newest, at, warn, block):
    age = f"(epoch_us(timestamp '{at}') - epoch_us(m)) / 3.6e9"
    return found(source, f"(select count(*) as n, max({newest}) as m from {rows})", "null", case("newest", ("EMPTY_SOURCE", 2, "n = 0"), ("TS_UNPARSEABLE", 2, "m is null"), ("STALE_BLOCK", 2, f"{age} > {block}"), ("STALE_WARN", 1, f"{age} > {warn}")))


def hours(a, b):
    return f"((epoch_us({a}) - epoch_us({b})) / 3.6e9)"


def last(x, by, order="p"):
    return f"last_value({x} ignore nulls) over (partition by {by} order by {order} rows between unbounded preceding and 1 preceding)"


def top(x, by, order="p"):
    return f"max({x}) over (partition by {by} order by {order} rows between unbounded preceding and 1 preceding)"


def again(key, order="p"):
    return f"row_number() over (partition by {key} order by {order}) > 1"


def within(x, r, warn=False):
    low, high = (r.low if r.warn_low is None else r.warn_low, r.high if r.warn_high is None else r.warn_high) if warn else (r.low, r.high)
    return f"case when {x} between {low} and {high} then {x} end"


def step(field, x, before, limits, days=None):
    m = f"abs(ln(case when {x} > 0 and {before} > 0 then {x} / {before} end))" + ("" if days is None else f" / sqrt(greatest({days}, 1.0))")
    return over(field, "JUMP", m, limits.warn, limits.block)


def register(name, sql):
    return query(sql, name)


# Readings and outcomes: events of users in the order of their numbers.
VALUE, KEY = C.Range(0.5, 80.0, 1.0, 60.0), C.Range(1.0, 120.0, 2.0)
KEYS = C.Pair("value", "k", 1.0, 0.5, 1.5)
E = "e as (select event_id as p, user_id as u, ts, event_type as kind, value, cast(json_extract(props, '$.k') as double) as k, case when event_type = 'error' then props else 'false' end as flag from events)"
READ_SQL = f"""with {E}, x as (select *, {last(within('value', VALUE), 'u')} as pv, {top('ts', 'u')} as pt, {again('u, ts')} as rep from e)
{found('readings', 'x', 'p', case('ts', ('TS_FUTURE', 2, f"ts > timestamp '{EVENTS_NOW}' + interval 5 minute")), case('ts', ('TS_NOT_AFTER_PREVIOUS', 2, 'ts <= pt')), case('ts', ('DUPLICATE_KEY', 2, 'rep')), over('ts', 'GAP', hours('ts', 'pt'), 48, 168), num('value', 'value', VALUE), num('k', 'k', KEY),
case('value/k', ('RATIO_BLOCK', 2, f"abs(({within('value', VALUE, True)}) / ({within('k', KEY, True)}) - 1) > 1.5"), ('RATIO_WARN', 1, f"abs(({within('value', VALUE, True)}) / ({within('k', KEY, True)}) - 1) > 0.5")), step('value', within('value', VALUE), 'pv', C.Steps(2.1, 3.3)))}
union all {stale('readings', 'e', 'ts', EVENTS_NOW, 48, 168)}"""


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", k.alias("k"), F.when(F.col("event_type") == "error", F.col("props")).otherwise("false").alias("flag"))


@register("source_readings", READ_SQL)
def readings(spark, sf_dir):
    return C.readings(events(spark, sf_dir), now(EVENTS_NOW), ["user_id"], "event_id", "ts", {"value": VALUE, "k": KEY}, [KEYS], "event_type", "value", C.Steps(2.1, 3.3))


OUT_SQL = f"""with {E}, x as (select *, {top('ts', '1')} as pt, {again('ts')} as rep from e)
{found('outcomes', 'x', 'p', case('event_type', ('SCHEMA_UNKNOWN_VALUE', 1, "kind not in ('view', 'click', 'purchase', 'error')")), case('flag', ('SCHEMA_BAD_TYPE', 1, "flag not in ('true', 'false')")), case('ts', ('TS_FUTURE', 2, f"ts > timestamp '{EVENTS_NOW}' + interval 5 minute")), case('ts', ('TS_NOT_AFTER_PREVIOUS', 2, 'ts < pt')), case('ts', ('DUPLICATE_KEY', 2, 'rep')), over('ts', 'GAP', hours('ts', 'pt'), 0.5, 1))}
union all {stale('outcomes', 'e', 'ts', EVENTS_NOW, 0.5, 1)}"""


@register("source_outcomes", OUT_SQL)
def outcomes(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("all", F.lit(0))
    return C.outcomes(e, now(EVENTS_NOW), ["all"], "event_id", "ts", "event_type", ["view", "click", "purchase", "error"], "flag", (0.5, 1.0), rows=2000)


# Fixes: the highest and lowest orders of a day; closed ones are the morning, others the evening. Arrival: the day's first order.
LOW = C.Range(2.0, 450.0, 4.0)
FIX = {"am": PRICE, "am_low": LOW}
EVE = {"pm": PRICE, "pm_low": LOW}
PURITY = [C.Pair("am_low", "am", 0.4, 0.51, 0.97), C.Pair("pm_low", "pm", 0.4, 0.51, 0.97)]
DAYS = """o as (select min(o_orderkey) as p, cast(o_orderdate as date) as d, max(case when o_orderstatus = 'F' then o_totalprice end) / 1000 as am, min(case when o_orderstatus = 'F' then o_totalprice end) / 1000 as am_low,
max(case when o_orderstatus <> 'F' then o_totalprice end) / 1000 as pm, min(case when o_orderstatus <> 'F' then o_totalprice end) / 1000 as pm_low from orders group by 2)"""
ORDERS_DAY = "cast('2001-08-06' as date)"


def working(a, b):
    n = lambda x: f"datediff('day', date '1970-01-05', {x})"
    w = lambda x: f"(5 * ({n(x)} // 7) + least({n(x)} % 7, 4))"
    return f"({w(b)} - {w(a)})"


FIX_SQL = f"""with {DAYS}, x as (select *, coalesce(pm, am) as raw, coalesce({within('pm', PRICE)}, {within('am', PRICE)}) as ref, {top('d', '1')} as latest, max(p) over () = p as newest, lag(d) over (order by d) as pd, lag(coalesce(pm, am)) over (order by d) as pv from o)
{found('fixes', 'x', 'p', *[f"case when {c} is not null then {num(c, c, r)} end" for c, r in {**FIX, **EVE}.items()], case('morning', ('NULL_VALUE', 2, 'am is null or am_low is null')), case('evening', ('NULL_VALUE', 1, '(pm is null or pm_low is null) and not newest')),
*[over(f'{q.a}/{q.b}', 'RATIO', f"abs(({within(q.a, LOW)}) / ({within(q.b, PRICE)}) / {q.expected} - 1)", q.warn, q.block) for q in PURITY], over('pm/am', 'RATIO', f"abs(({within('pm', PRICE)}) / ({within('am', PRICE)}) - 1)", 0.303, 0.607),
case('day', ('TS_ORDER', 1, 'd < latest')), step('pm', 'ref', 'pv', C.Steps(0.41, 0.83), "datediff('day', pd, d)"), over('day', 'GAP', f"(case when ref is not null and pv is not null then {working('pd', 'd')} end)", 1, 2))}
union all {found('fixes', '(select max(d) as m from o)', 'null', over('newest', 'STALE', working('m', ORDERS_DAY), 1, 2))}"""


def order_days(spark, sf_dir):
    o, closed, v = table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice")
    g = o.groupBy(F.to_date("o_orderdate").alias("day"))
    return g.agg(F.min("o_orderkey").alias("p"), *[(f(F.when(c, v)) / 1000).alias(n) for n, c, f in (("am", closed, F.max), ("am_low", closed, F.min), ("pm", ~closed, F.max), ("pm_low", ~closed, F.min))])


@register("source_fixes", FIX_SQL)
def fixes(spark, sf_dir):
    d = order_days(spark, sf_dir).withColumns({"all": F.lit(0), "fetched": F.col("day").cast("timestamp")})
    return C.fixes(d, now(ORDERS_NOW), ["all"], "p", "day", "fetched", FIX, EVE, PURITY, ("am", "pm"), (0.303, 0.607), C.Steps(0.41, 0.83), (1, 2), least_year=1990)


# Snapshots: orders are captures of the part that their status names; pending ones have their priority for a city.
O = "o as (select o_orderkey as p, o_orderdate as cap, o_orderdate - to_seconds(cast(round(o_totalprice) as bigint)) as obs, o_orderstatus as part, case when o_orderstatus = 'P' then o_orderpriority end as city, o_totalprice / 1000 as rate from orders)"
SNAP_SQL = f"""with {O}, x as (select *, {within('rate', PRICE)} as ok, {top('cap', '1')} as latest, {again('cap, part, city')} as rep from o), y as (select *, {last('ok', 'part, city', 'cap, p')} as pv from x)
{found('snapshots', 'y', 'p', num('rate', 'rate', PRICE), case('city', ('SCHEMA_UNKNOWN_VALUE', 2, "part = 'P' and city not in ('1-URGENT', '2-HIGH')")), case('cap', ('DUPLICATE_KEY', 2, 'rep')), case('cap', ('TS_ORDER', 1, 'cap < latest')), step('rate', 'ok', 'pv', C.Steps(1.03, 2.07)),
f"case when part = 'F' then {over('obs', 'STALE', hours('cap', 'obs'), 48, 96)} end", f"case when part = 'P' then {over('obs', 'STALE', hours('cap', 'obs'), 24, 72)} end")}
union all {found('snapshots', "(select cap, max(v) as hi, min(v) as lo from (select cap, part, arg_max(ok, p) as v from x where ok is not null and city is null and part in ('F', 'O') group by 1, 2) group by 1 having count(*) > 1)", 'cap', over('parts', 'CROSS_SOURCE', '((hi - lo) / ((hi + lo) / 2))', 0.21, 0.63))}
union all {found('snapshots', "(select part, m from (values ('F'), ('O'), ('N'), ('P')) n(part) left join (select part, max(cap) as m from x where ok is not null group by 1) using (part))", 'part', case('newest', ('STALE_BLOCK', 2, f"m is null or {hours(f"timestamp '{ORDERS_NOW}'", 'm')} > 2000"), ('STALE_WARN', 1, f"{hours(f"timestamp '{ORDERS_NOW}'", 'm')} > 24")))}"""


@register("source_snapshots", SNAP_SQL)
def snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cap = F.col("o_orderdate").cast("timestamp")
    d = o.select(F.col("o_orderkey").alias("p"), cap.alias("cap"), F.timestamp_seconds(F.unix_seconds(cap) - F.round("o_totalprice").cast("long")).alias("obs"), F.col("o_orderstatus").alias("part"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("city"), (F.col("o_totalprice") / 1000).alias("rate"))
    return C.snapshots(d, now(ORDERS_NOW), "p", "cap", "obs", "part", "city", "rate", PRICE, C.Steps(1.03, 2.07), ["F", "O", "N"], {"P": ["1-URGENT", "2-HIGH"]}, {"F": (48.0, 96.0), "P": (24.0, 72.0)}, (0.21, 0.63), (24.0, 2000.0), least_year=1990)


# Fusions: a state a day, from the urgent orders; cities are priorities, failures the pending orders' priorities.
FUSE_SQL = f"""with f as (select cast(o_orderdate as date) as d, avg(case when o_orderpriority = '1-URGENT' then o_totalprice / 1000 end) as v, stddev_samp(case when o_orderpriority = '1-URGENT' then o_totalprice / 1000 end) as h from orders group by 1),
c as (select cast(o_orderdate as date) as d, o_orderpriority as city, max(o_totalprice) / 1000 as v, count(case when o_orderstatus = 'P' then 1 end) as failed from orders group by 1, 2)
{found('fused_outputs', 'f', 'd', case('v', ('NULL_VALUE', 1, 'v is null')), f"case when v is not null then {num('v', 'v', PRICE)} end", f"case when v is not null then {case('h', ('VALUE_NOT_NUMERIC', 2, f'h is null or not v between {PRICE.warn_low} and {PRICE.warn_high}'), ('VALUE_OUT_OF_RANGE', 1, 'h > 0.1 * v'))} end")}
union all {found('fused_outputs', 'c', "d || ':' || city", num('v', 'city', PRICE))}
union all {found('fused_outputs', '(select * from c where failed > 0)', "d || ':' || city", case('failures', ('SOURCE_REPORTED_FAILURE', 1, 'true')))}
union all {stale('fused_outputs', 'f', 'd', ORDERS_NOW, 12, 2000)}"""


@register("source_fusions", FUSE_SQL)
def fusions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 1000).alias("x"), F.col("o_orderpriority").alias("city"), (F.col("o_orderstatus") == "P").alias("late"))
    urgent = F.when(F.col("city") == "1-URGENT", F.col("x"))
    c = o.groupBy("day", "city").agg(F.max("x").alias("top"), F.max("late").alias("late"), F.sum(urgent).alias("s"))
    entries = F.map_from_entries(F.collect_list(F.struct("city", "top")))
    failed = F.map_from_entries(F.collect_list(F.when(F.col("late"), F.struct("city", F.lit("late")))))
    maps = c.groupBy("day").agg(entries.alias("cities"), failed.alias("failures"))
    d = o.groupBy("day").agg(F.avg(urgent).alias("v"), F.stddev_samp(urgent).alias("h"), F.collect_set(F.when(urgent.isNotNull(), F.col("city"))).alias("used")).join(maps, "day")
    d = d.withColumn("cap", F.col("day").cast("timestamp"))
    return C.fused_outputs(d, now(ORDERS_NOW), "day", "cap", "day", "v", "h", "used", PRICE, ["failures"], "cities", gap=(12.0, 2000.0), least_year=1990)


# Features: a row for each status and day; values are carried forward with the day they are of.
FEATURES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}
FIELDS = {c: PRICE for c in FEATURES}
FEATURE_ROWS = f"""w0 as (select o_orderstatus as part, cast(o_orderdate as date) as d, min(o_orderkey) as p, {', '.join(f"max(case when o_orderpriority = '{v}' then o_totalprice end) / 1000 as {k}0" for k, v in FEATURES.items())} from orders group by 1, 2),
w as (select part, d, p, {', '.join(f"last_value({k}0 ignore nulls) over r as {k}, last_value(case when {k}0 is not null then d end ignore nulls) over r as {k}_asof_date" for k in FEATURES)} from w0 window r as (partition by part order by d rows between unbounded preceding and current row))"""
STEP = C.Steps(0.52, 1.04)
FEATURE_SQL = f"""with {FEATURE_ROWS}, x as (select *, lag(d) over (partition by part order by d) as pd, {', '.join(f"{last(k, 'part', 'd')} as b_{k}, {last(f'case when {k} is not null then d end', 'part', 'd')} as bd_{k}" for k in FEATURES)} from w)
{found('feature_store', 'x', "part || ' ' || d", case('urgent', ('NULL_VALUE', 2, 'urgent is null')), *[f"case when {k} is not null then {num(k, k, PRICE)} end" for k in FEATURES], *[case(f'{k}_asof_date', ('STALE_WARN', 1, f"datediff('day', {k}_asof_date, d) > 6")) for k in FEATURES],
*[step(k, k, f'b_{k}', STEP, f"datediff('day', bd_{k}, d)") for k in FEATURES], case('urgent/high', ('CROSS_SOURCE_BLOCK', 2, '(urgent / (high / 1.0)) not between 0.3503 and 2.2507'), ('CROSS_SOURCE_WARN', 1, '(urgent / (high / 1.0)) not between 0.6003 and 1.5007')))}
union all {found('feature_store', "(select max(d) as m from w where part = 'O')", "'O'", case('newest', ('STALE_BLOCK', 2, f"m is null or {hours(f"timestamp '{ORDERS_NOW}'", 'm')} > 2000"), ('STALE_WARN', 1, f"{hours(f"timestamp '{ORDERS_NOW}'", 'm')} > 24")))}"""


def by_priority(keys):
    return lambda o: o.groupBy(*keys, F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("p"), *[(F.max(F.when(F.col("o_orderpriority") == v, F.col("o_totalprice"))) / 1000).alias(k) for k, v in FEATURES.items()])


@register("source_features", FEATURE_SQL)
def features(spark, sf_dir):
    d = by_priority([F.col("o_orderstatus").alias("part")])(table(spark, sf_dir, "orders"))
    d = d.withColumns({f"{c}_asof_date": F.when(F.col(c).isNotNull(), F.col("day")) for c in FEATURES})
    names = [x for c in FEATURES for x in (c, f"{c}_asof_date")]
    d = W.forward_fill(d, ["part"], "day", names)
    d = d.select(F.concat_ws(" ", "part", F.col("day").cast("string")).alias("p"), "part", "day", F.col("day").cast("timestamp").alias("cap"), *[F.col(f"{c}_filled").alias(c) for c in names])
    return C.feature_store(d, now(ORDERS_NOW), "p", "cap", "day", "part", FIELDS, ["urgent"], {c: STEP for c in FEATURES}, band=("urgent", "high", 1.0, (0.6003, 1.5007), (0.3503, 2.2507)), live_part="O", gap=(24.0, 2000.0), least_year=1990)


# A frame: a row a day in order of arrival.
FRAME_SQL = f"""with w as (select cast(o_orderdate as date) as d, min(o_orderkey) as p, {', '.join(f"max(case when o_orderpriority = '{v}' then o_totalprice end) / 1000 as {k}" for k, v in FEATURES.items())} from orders group by 1),
x as (select *, {top('d', '1')} as latest, {', '.join(f"{last(within(k, PRICE), '1')} as b_{k}, {last(f'case when {k} between {PRICE.low} and {PRICE.high} then d end', '1')} as bd_{k}" for k in FEATURES)} from w)
{found('frame', 'x', 'p', case('urgent', ('NULL_VALUE', 1, 'urgent is null')), *[f"case when {k} is not null then {num(k, k, PRICE)} end" for k in FEATURES], *[f"case when d > bd_{k} then {step(k, within(k, PRICE), f'b_{k}', STEP, f"datediff('day', bd_{k}, d)")} end" for k in FEATURES])}
union all {found('frame', '(select max((d < latest)::int) as bad from x)', 'null', case('at', ('TS_ORDER', 1, 'bad = 1')))}
union all {stale('frame', 'w', 'd', ORDERS_NOW, 120, 2000)}"""


@register("source_frame", FRAME_SQL)
def frame(spark, sf_dir):
    d = by_priority([])(table(spark, sf_dir, "orders")).withColumn("at", F.col("day").cast("timestamp"))
    return C.frame(d, now(ORDERS_NOW), "p", "at", FIELDS, {c: STEP for c in FEATURES}, ["urgent"], gap=(120.0, 2000.0), least_year=1990)


# Two histories: the mean order of a day, and the mean of the line items shipped on it.
SEED = C.Range(60.0, 450.0, None, 300.0)
LINES = C.Range(5.0, 120.0, None, 60.0)
DAYS_OF = {"label": ("orders", "o_orderdate", "o_totalprice / 1000", "o_orderkey"), "proxy": ("lineitem", "l_shipdate", "l_extendedprice / 200", "l_orderkey")}


def history(which):
    source, day, x, _ = DAYS_OF[which]
    return f"{which} as (select cast({day} as date) as d, avg({x}) as {which}, max({x}) as hi, count(*) > 3 as oos, cast(count(*) as double) as pct from {source} group by 1)"


SEED_SQL = f"""with {history('label')}, x as (select *, lag(label) over (order by d) as pv, lag(d) over (order by d) as pd from label)
{found('seed', 'x', 'd', num('label', 'label', SEED), num('hi', 'hi', SEED), case('pct', ('VALUE_OUT_OF_RANGE', 2, 'pct > 30')), step('label', 'label', 'pv', C.Steps(0.41, 0.83)), case('day', ('GAP_WARN', 1, "datediff('day', pd, d) > 5")))}"""


def seed_days(spark, sf_dir, which):
    source, day, x, _ = DAYS_OF[which]
    g = table(spark, sf_dir, source).groupBy(F.to_date(day).alias("day"))
    return g.agg(F.avg(F.expr(x)).alias(which), F.max(F.expr(x)).alias("hi"), (F.count(F.lit(1)) > 3).alias("oos"), F.count(F.lit(1)).cast("double").alias("pct"))


@register("source_seed", SEED_SQL)
def seed(spark, sf_dir):
    d = seed_days(spark, sf_dir, "label").withColumn("p", F.col("day"))
    return C.seed(d, now(ORDERS_NOW), "p", "day", ["label", "hi"], SEED, "label", C.Steps(0.41, 0.83), ["oos"], "pct", least_year=1990)


TWO_SQL = f"""with {history('label')}, {history('proxy')}, j as (select d, label, proxy from label join proxy using (d))
{found('seeds', 'j', 'd', over('values', 'CROSS_SOURCE', 'abs(label / proxy - 1)', 0.1501, 0.3003))}
union all {found('seeds', '(select (select count(*) from j) as b, (select count(*) from label) as l, (select count(*) from proxy) as r)', 'null', case('days', ('CROSS_SOURCE_BLOCK', 2, 'b < 0.9 * least(l, r)')))}"""


@register("source_two_seeds", TWO_SQL)
def two_seeds(spark, sf_dir):
    return C.two_seeds(seed_days(spark, sf_dir, "label"), seed_days(spark, sf_dir, "proxy"), "day", "label", "proxy", (0.1501, 0.3003))


EACH = {"readings": (readings, READ_SQL), "outcomes": (outcomes, OUT_SQL), "fixes": (fixes, FIX_SQL), "snapshots": (snapshots, SNAP_SQL), "fused_outputs": (fusions, FUSE_SQL), "feature_store": (features, FEATURE_SQL), "frame": (frame, FRAME_SQL), "seed": (seed, SEED_SQL), "seeds": (two_seeds, TWO_SQL)}
REPORT_SQL = f"""with f as ({' union all '.join(f'select * from ({sql})' for _, sql in EACH.values())}), n(source) as (values {', '.join(f"('{s}')" for s in EACH)})
select source, case max(severity) when 2 then 'block' when 1 then 'warn' when 0 then 'info' else 'ok' end as status, count(case when severity = 0 then 1 end) as n_info, count(case when severity = 1 then 1 end) as n_warn, count(case when severity = 2 then 1 end) as n_block from n left join f using (source) group by 1"""


@register("source_reports", REPORT_SQL)
def source_reports(spark, sf_dir):
    return C.reports([f(spark, sf_dir) for f, _ in EACH.values()], list(EACH))
