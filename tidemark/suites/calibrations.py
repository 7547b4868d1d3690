"""Robust walk-forward calibrations, stale days and long histories over the driver's tables.

Readings are the highest urgent orders of a day, fixes the highest low ones, the benchmark the highest medium one, for closed and other orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hot as H
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.plans import freshness as S
from tidemark.plans import proxy as P
from tidemark.sources.readers import table
from tidemark.suites import query

SIDES = {"1-URGENT": "reading", "2-HIGH": "reading", "3-MEDIUM": "bench", "4-NOT SPECIFIED": "fix", "5-LOW": "fix"}
SIDE_SQL = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in SIDES.items()) + " end"
BASE = f"""o as materialized (select case when o_orderstatus = 'F' then 'closed' else 'open' end as k, cast(o_orderdate as date) as d, {SIDE_SQL} as side, max(o_totalprice) / 1000 as v from orders group by 1, 2, 3)"""
BY = "partition by k order by d"
SCALE = 10 / 31.1034768 * 22 / 24


def r(c, n=6):
    return F.round(c, n)


def sides(spark, sf_dir, name):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin([k for k, v in SIDES.items() if v == name]))
    key = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return o.groupBy(key.alias("k"), F.to_date("o_orderdate").alias("d")).agg((F.max("o_totalprice") / 1000).alias(name))


def fit_sql(rows: str, pairs: str, least: int = 30, steps: int = 8) -> str:
    """CTEs fit{steps}(k, d, a, b) and h, the weighted pairs (k, j, x, y) before each of rows (k, d, c: pairs before)."""
    sums = lambda w: f"sum({w}) as w, sum({w} * x) as sx, sum({w} * y) as sy, sum({w} * x * x) as xx, sum({w} * x * y) as xy"
    slope = "case when w * xx - sx * sx > 1e-9 * w * w then (w * xy - sx * sy) / (w * xx - sx * sx) else 0 end"
    line = lambda g: f"select k, d, a, (sy - a * sx) / w as b from (select *, {slope} as a from ({g}))"
    out = [f"h as materialized (select t.k, t.d, p.x, p.y, pow(2.0, -(t.c - p.j) / 10.0) as w from {rows} t join {pairs} p on p.k = t.k and p.j > t.c - 200 and p.j <= t.c where t.c >= {least})"]
    out.append(f"fit0 as materialized ({line(f'select k, d, {sums("w")} from h group by k, d')})")
    for i in range(1, steps + 1):
        f = f"fit{i - 1}"
        out.append(f"s{i} as materialized (select k, d, quantile_cont(abs(y - a * x - b), 0.5) * (1.35 / 0.6744897501960817) as s from h join {f} using (k, d) group by k, d)")
        weight = "u"
        grouped = f"select k, d, {sums(weight)} from (select k, d, x, y, w * least(1.0, s / greatest(abs(y - a * x - b), 1e-300)) as u from h join {f} using (k, d) join s{i} using (k, d) where s > 0) group by k, d"
        out.append(f"fit{i} as materialized (select q.k, q.d, coalesce(n.a, q.a) as a, coalesce(n.b, q.b) as b from {f} q left join ({line(grouped)}) n using (k, d))")
    return ", ".join(out)


def weighted_quantile_sql(values: str, q: float) -> str:
    """(k, d, v): the weighted quantile of values (k, d, e, w)."""
    return f"select k, d, min(e) as v from (select *, sum(w) over (partition by k, d order by e, w rows between unbounded preceding and current row) as cum, sum(w) over (partition by k, d) as total from {values}) where cum >= total * {q - 1e-12!r} group by k, d"


def numbered(name: str, source: str, cond: str, columns: str) -> str:
    """The rows of source with cond, numbered by day."""
    return f"{name} as materialized (select k, d, {columns}, row_number() over ({BY}) as j from {source} where {cond})"


SCORED = f"""{BASE}, y as (select k, d, v as y, lag(d) over ({BY}) as d0, lag(v) over ({BY}) as y0 from o where side = 'reading'),
a as (select y.*, x.v as x, x.d as fd, cast(y.d - x.d as int) as gap from y asof join (select * from o where side = 'fix') x on y.k = x.k and y.d >= x.d where y.d - x.d < 14),
t as materialized (select *, count(case when gap = 0 then 1 end) over ({BY} rows between unbounded preceding and 1 preceding) as c, count(case when gap > 0 then 1 end) over ({BY} rows between unbounded preceding and 1 preceding) as cs from a),
{numbered('p', 't', 'gap = 0', 'x, y')}, {numbered('st', 't', 'gap > 0', 'x, y')}, {fit_sql('t', 'p')},
hw as materialized ({weighted_quantile_sql('(select k, d, abs(y - a * x - b) as e, w from h join fit8 using (k, d))', 0.8)}),
hs as materialized ({weighted_quantile_sql('(select t.k, t.d, abs(s.y - a * s.x - b) as e, pow(2.0, -(t.cs - s.j) / 10.0) as w from t join fit8 using (k, d) join st s on s.k = t.k and s.j > t.cs - 200 and s.j <= t.cs where t.gap > 0 and t.cs >= 8)', 0.8)}),
z as materialized (select t.k, t.d, t.y, t.gap, t.d0, t.y0, t.c as n_train, a * t.x + b as est, hw.v as hw, coalesce(hs.v, hw.v) as hws, t.gap > 0 and hs.v is null as fell from t join fit8 using (k, d) join hw using (k, d) left join hs using (k, d))"""


def scored(spark, sf_dir):
    return S.scored_days(sides(spark, sf_dir, "reading"), sides(spark, sf_dir, "fix"), ["k"], "d", "reading", "fix")


@query(f"with {SCORED} select k, d, gap as gap_days, n_train, round(est, 6) as estimate, round(hw, 6) as half_width, round(hws, 6) as half_width_stratified, fell as fell_back from z")
def freshness_bands(spark, sf_dir):
    return scored(spark, sf_dir).select("k", "d", "gap_days", "n_train", *[r(c).alias(c) for c in ("estimate", "half_width", "half_width_stratified")], "fell_back")


@query(f"""with {SCORED} select k, case when gap > 0 then 'carry_forward' else 'same_day' end as stratum, count(*) as n, sum((abs(y - est) <= hw)::int)::bigint as in_band, sum((abs(y - est) <= hws)::int)::bigint as in_stratified,
round(avg(hw), 6) as mean_half_width, round(avg(hws), 6) as mean_stratified, sum(fell::int)::bigint as fallback_days from z group by 1, 2""")
def freshness_coverage(spark, sf_dir):
    g = S.coverage(scored(spark, sf_dir), ["k"], "reading")
    return g.select("k", "stratum", "n", "in_band", "in_stratified", r("mean_half_width").alias("mean_half_width"), r("mean_stratified").alias("mean_stratified"), "fallback_days")


def past_quantile(name: str, rows: str, count: str, source: str, least: int, q: float, cond: str) -> str:
    """name(k, d, v): weighted quantile of the last 200 values e of source (numbered j) before each of rows, with at least `least` of them."""
    inner = f"(select t.k, t.d, s.e, pow(2.0, -(t.{count} - s.j) / 10.0) as w from {rows} t join {source} s on s.k = t.k and s.j > t.{count} - 200 and s.j <= t.{count} where t.{count} >= {least} and {cond})"
    return f"{name} as materialized ({weighted_quantile_sql(inner, q)})"


BEFORE = f"over ({BY} rows between unbounded preceding and 1 preceding)"


@query(f"""with {SCORED}, b as (select k, d, v as bench from o where side = 'bench'),
q0 as materialized (select z.*, bench, case when gap > 0 and d - d0 <= 4 then y0 end as carried from z left join b using (k, d)),
q1 as materialized (select *, count(case when carried is not null then 1 end) {BEFORE} as c2, count(case when gap > 0 and bench is not null then 1 end) {BEFORE} as cr from q0),
{numbered('e2', 'q1', 'carried is not null', 'abs(carried - y) as e')}, {numbered('rt', 'q1', 'gap > 0 and bench is not null', 'y / bench as e')},
{past_quantile('w2', 'q1', 'c2', 'e2', 8, 0.8, 't.gap > 0')}, {past_quantile('ra', 'q1', 'cr', 'rt', 8, 0.5, 't.gap > 0 and t.bench is not null')},
q2 as materialized (select q1.*, w2.v as w2, ra.v * bench as own3 from q1 left join w2 using (k, d) left join ra using (k, d)),
q3 as materialized (select *, count(case when own3 is not null then 1 end) {BEFORE} as c3 from q2), {numbered('e3', 'q3', 'own3 is not null', 'abs(own3 - y) as e')}, {past_quantile('w3', 'q3', 'c3', 'e3', 8, 0.8, 't.gap > 0 and t.bench is not null')},
f as (select q3.*, w3.v as w3, gap > 0 as stale, gap > 0 and bench is not null as tried, coalesce(carried, est) as s2, coalesce(w2, hw) as h2 from q3 left join w3 using (k, d))
select k, d, gap as gap_days, round(est, 6) as s1_estimate, round(hw, 6) as s1_half_width, round(s2, 6) as s2_estimate, round(h2, 6) as s2_half_width, stale and carried is null as s2_estimate_fallback, stale and w2 is null as s2_band_fallback,
round(case when tried then coalesce(own3, s2) end, 6) as s3_estimate, round(case when tried then coalesce(w3, h2) end, 6) as s3_half_width, case when tried then own3 is null end as s3_estimate_fallback, case when tried then w3 is null end as s3_band_fallback from f""")
def stale_day_strategies(spark, sf_dir):
    d = scored(spark, sf_dir).join(sides(spark, sf_dir, "bench"), ["k", "d"], "left")
    d = S.stale_day_strategies(d, ["k"], "d", "reading", "bench")
    numbers = [f"s{i}_{c}" for i in (1, 2, 3) for c in ("estimate", "half_width")]
    return d.select("k", "d", "gap_days", *[r(c).alias(c) for c in numbers], *[f"s{i}_{c}_fallback" for i in (2, 3) for c in ("estimate", "band")])


STEPS = [("1996-03-01", 10.0), ("1997-07-15", 12.5), ("1999-01-01", 6.0)]
RATIO = "ln({0} / lag({0}) over (" + BY + "))"
DRIVERS = f"""{BASE}, sp as (select k, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from o group by k),
fl as materialized (select sp.k, sp.d, last_value(f.v ignore nulls) over w as fut, last_value(b.v ignore nulls) over w as ref, 40.0 + extract(day from sp.d) as fx from sp left join (select * from o where side = 'fix') f using (k, d) left join (select * from o where side = 'bench') b using (k, d) window w as (partition by sp.k order by sp.d)),
g as (select *, {RATIO.format('fut')} - {RATIO.format('ref')} as g from fl),
m as materialized (select *, count(g) over u as n, stddev_samp(g) over u as sd, g - quantile_cont(g, 0.5) over u as ex from g window u as ({BY} rows between 59 preceding and current row)),
rl as materialized (select *, coalesce(n >= 20 and sd > 0 and abs(ex) > 2.5 * sd, false) as roll from m),
aj as materialized (select *, fut * exp(-sum(case when roll then ex else 0 end) over ({BY})) as adj from rl)"""


def drivers(spark, sf_dir):
    parts = [sides(spark, sf_dir, c) for c in ("reading", "fix", "bench")]
    days = J.spine(parts[0].select("k", "d").unionByName(parts[1].select("k", "d")).unionByName(parts[2].select("k", "d")).distinct(), ["k"], "d")
    d = days.join(parts[1], ["k", "d"], "left").join(parts[2], ["k", "d"], "left")
    d = W.forward_fill(d, ["k"], "d", ["fix", "bench"])
    return d.select("k", "d", F.col("fix_filled").alias("future"), F.col("bench_filled").alias("reference"), (40.0 + F.dayofmonth("d")).alias("fx"))


@query(f"with {DRIVERS} select k, d, roll, round(ln(adj), 6) as log_adjusted from aj")
def roll_adjusted(spark, sf_dir):
    return P.adjust_rolls(drivers(spark, sf_dir), ["k"], "d", "future", "reference", sigmas=2.5).select("k", "d", "roll", r(F.ln("adjusted")).alias("log_adjusted"))


@query(f"""with sched(eff, pct) as (values {', '.join(f"(date '{a}', {b}::double)" for a, b in STEPS)}), {DRIVERS.replace('2.5 * sd', '6.0 * sd')},
lg as (select k, d, lag(adj) over w * lag(fx) over w * {SCALE!r} as raw, coalesce(lag(roll) over w, false) as rolled from aj window w as ({BY})),
du as materialized (select lg.*, coalesce(pct, 4.0) as pct, raw * (1 + coalesce(pct, 4.0) / 100) as x from lg asof left join sched on lg.d >= sched.eff),
yy as (select du.*, v as y from du left join (select * from o where side = 'reading') q using (k, d)),
t as materialized (select *, x is not null and y is not null as pair, count(case when x is not null and y is not null then 1 end) {BEFORE} as c from yy),
{numbered('p', 't', 'pair', 'x, y')}, oo as materialized (select * from t where pair and c >= 30), {fit_sql('oo', 'p')}, ff as (select oo.k, a as a0, b as b0 from oo join fit8 using (k, d) where oo.c = 30)
select t.k, t.d, round(raw, 6) as raw_pre_duty, pct as duty_pct, round(t.x, 6) as raw_with_duty, round(coalesce(coalesce(f.a, a0) * t.x + coalesce(f.b, b0), t.x), 6) as proxy, pair and c >= 30 as is_oos, rolled as roll_adjusted from t left join fit8 f using (k, d) left join ff on ff.k = t.k""")
def long_history_proxy(spark, sf_dir):
    steps = spark.createDataFrame(STEPS, "effective string, pct double").withColumn("effective", F.col("effective").cast("date"))
    d = P.long_history(drivers(spark, sf_dir), sides(spark, sf_dir, "reading"), steps, ["k"], "d", "future", "reference", "fx", "reading", SCALE)
    return d.select("k", "d", "duty_pct", "is_oos", "roll_adjusted", *[r(c).alias(c) for c in ("raw_pre_duty", "raw_with_duty", "proxy")])


@query("""with e as (select event_id, event_type, ts, value, 'all' as k from events), p as (select ts as bought_at, max(event_id) as purchase_id from e where event_type = 'purchase' group by 1)
select e.event_id, p.purchase_id, epoch_us(e.ts) - epoch_us(p.bought_at) as micros_since from e asof left join p on e.ts >= p.bought_at where event_type <> 'purchase'""")
def asof_one_hot_key(spark, sf_dir):
    """The latest purchase of anyone before each other event: one key with all rows, cut into pieces of time."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.lit("all").alias("k"))
    p = e.where("event_type = 'purchase'").groupBy("k", F.col("ts").alias("bought_at")).agg(F.max("event_id").alias("purchase_id"))
    d = H.asof_backward(e.where("event_type <> 'purchase'"), p, ["k"], "ts", "bought_at", ["purchase_id"], rows=1000)
    return d.select("event_id", "purchase_id", (F.unix_micros("ts") - F.unix_micros("bought_at")).alias("micros_since"))


@query("""with e as (select ts, max(event_id) as event_id, max(case when event_type = 'error' then value end) as v from events group by 1)
select event_id, round(last_value(v ignore nulls) over (order by ts rows between unbounded preceding and current row), 6) as v_filled from e""")
def fill_one_hot_key(spark, sf_dir):
    """The value of the latest error at each moment, filled forward over one key with all rows."""
    e = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("timestamp").alias("ts")).agg(F.max("event_id").alias("event_id"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("v"))
    return H.fill_forward(e.withColumn("k", F.lit("all")), ["k"], "ts", ["v"], rows=1000).select("event_id", r("v_filled").alias("v_filled"))
