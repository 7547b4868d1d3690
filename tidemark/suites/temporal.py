"""Temporal joins and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import asof as J
from tidemark.operators import joins as R
from tidemark.operators import windows as W
from tidemark.sources.readers import table
from tidemark.suites import DAILY, daily, query

CLICKS = "select user_id, ts, max(value) as click_value from events where event_type = 'click' group by 1, 2"


def sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max("value").alias("click_value"))
    return left, right


@query("""with x as (select user_id, cast(ts + interval 330 minute as date) as local_day, arg_max(value, (ts, event_id)) as value from events group by 1, 2),
t as (select *, avg(value) over w as avg30, count(*) over w as n30 from x window w as (partition by user_id order by local_day range between interval 30 day preceding and interval 1 day preceding))
select user_id, local_day, round(value, 4) as value, round(avg30, 8) as avg30, n30, case when n30 = 0 then null when value <= 0.9 * avg30 then 'cheap' when value <= 1.1 * avg30 then 'usual' else 'dear' end as tier from t""")
def cheap_today_tiers(spark, sf_dir):
    """Each user's last value of a local day against the mean of the thirty days before."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    x = A.last_per_local_day(e, ["user_id"], "ts", ["value"], tie=["event_id"])
    w = Window.partitionBy("user_id").orderBy(F.datediff("local_day", F.lit("1970-01-01").cast("date"))).rangeBetween(-30, -1)
    t = x.withColumn("avg30", F.avg("value").over(w)).withColumn("n30", F.count("value").over(w))
    tier = F.when(F.col("n30") == 0, None).when(F.col("value") <= 0.9 * F.col("avg30"), "cheap").when(F.col("value") <= 1.1 * F.col("avg30"), "usual").otherwise("dear")
    return t.select("user_id", "local_day", F.round("value", 4).alias("value"), F.round("avg30", 8).alias("avg30"), "n30", tier.alias("tier"))


@query("select event_type, cast(ts + interval 330 minute as date) as local_day, round(arg_max(value, (ts, event_id)), 6) as value, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def daily_last_local_tz(spark, sf_dir):
    d = A.last_per_local_day(table(spark, sf_dir, "events"), ["event_type"], "ts", ["value", "event_id"], tie=["event_id"])
    return d.select("event_type", "local_day", F.round("value", 6).alias("value"), "event_id")


def _asof(op: str, extra: str = "") -> str:
    return f"with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as ({CLICKS}) select l.event_id, l.user_id, l.ts, r.ts as click_ts, round(r.click_value, 6) as click_value from l asof left join r on l.user_id = r.user_id and l.ts {op} r.ts{extra}"


def _out(d):
    return d.select("event_id", "user_id", "ts", "click_ts", F.round("click_value", 6).alias("click_value"))


@query(_asof(">="))
def asof_backward(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return _out(J.asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_value"]))


@query(_asof(">"))
def asof_strict(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return _out(J.asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_value"], allow_exact=False))


@query(_asof("<="))
def asof_forward(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return _out(J.asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_value"], direction="forward"))


@query(f"with x as ({_asof('>=')}) select event_id, user_id, ts, case when click_ts >= ts - interval 3 day then click_ts end as click_ts, case when click_ts >= ts - interval 3 day then click_value end as click_value from x")
def asof_tolerance(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return _out(J.asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_value"], tolerance="3 days"))


@query(f"with x as ({_asof('>')}) select event_id, user_id, ts, click_ts, click_value from x where click_ts >= ts - interval 2 day")
def asof_known_before(spark, sf_dir):
    """Strict as-of on the known-at moment; rows without a fresh value are dropped."""
    left, right = sides(spark, sf_dir)
    return _out(J.known_before(left, right, ["user_id"], "ts", "click_ts", ["click_value"], tolerance="2 days", tolerance_keeps_row=False))


@query("""with f as (select o_orderpriority as k, datediff('day', date '1970-01-01', cast(o_orderdate as date)) * 2 + case when o_orderkey % 2 = 0 then 0 else 1 end as slot, max(o_totalprice) as fix from orders where o_orderstatus = 'F' group by 1, 2),
l as (select o_orderkey, o_orderpriority as k, datediff('day', date '1970-01-01', cast(o_orderdate as date)) * 2 + 1 as slot from orders where o_orderstatus = 'O')
select l.o_orderkey, l.slot, f.slot as fix_slot, round(f.fix, 2) as fix, coalesce(f.slot < l.slot - 1, true) as stale from l asof left join f on l.k = f.k and l.slot >= f.slot""")
def asof_slot_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    f = o.where("o_orderstatus = 'F'").withColumn("fix_slot", J.slot_key(day, F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(1))).groupBy(F.col("o_orderpriority").alias("k"), "fix_slot").agg(F.max("o_totalprice").alias("fix"))
    left = o.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderpriority").alias("k"), J.slot_key(day, F.lit(1)).alias("slot"))
    d = J.asof_join(left, f, ["k"], "slot", "fix_slot", ["fix"])
    return d.select("o_orderkey", "slot", "fix_slot", F.round("fix", 2).alias("fix"), F.coalesce(F.col("fix_slot") < F.col("slot") - 1, F.lit(True)).alias("stale"))


STEPS = [("1993-03-01", 10.0), ("1994-07-15", 12.5), ("1996-01-01", 6.0)]


@query("with s(eff, pct) as (values (date '1993-03-01', 10.0::double), (date '1994-07-15', 12.5::double), (date '1996-01-01', 6.0::double)) select o.o_orderkey, cast(o.o_orderdate as date) as d, coalesce(s.pct, 15.0) as pct from orders o asof left join s on cast(o.o_orderdate as date) >= s.eff")
def step_schedule_asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    s = spark.createDataFrame(STEPS, "eff string, pct double").withColumn("eff", F.col("eff").cast("date"))
    return J.step_schedule(o, s, "d", "eff", "pct", 15.0)


@query("""with e as (select user_id, ts, max(value) as value from events group by 1, 2)
select a.user_id, a.ts, round(a.value, 6) as value, round(b.value, 6) as value_7d_ago, round(lag(a.value) over (partition by a.user_id order by a.ts), 6) as value_prev from e a asof left join e b on a.user_id = b.user_id and a.ts - interval 7 day >= b.ts""")
def time_lag_features(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    d = J.time_lag(e, ["user_id"], "ts", "value", "7 days", "past")
    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts"))
    return d.select("user_id", "ts", F.round("value", 6).alias("value"), F.round("past", 6).alias("value_7d_ago"), F.round(prev, 6).alias("value_prev"))


EVENTS = [("1994-01-10", "harvest", 1), ("1994-01-14", "fair", 2), ("1995-06-01", "fair", 2)]
EVENT_SQL = "ev(ed, name, pr) as (values (date '1994-01-10', 'harvest', 1), (date '1994-01-14', 'fair', 2), (date '1995-06-01', 'fair', 2))"


def events(spark):
    return spark.createDataFrame(EVENTS, "ed string, name string, pr int").withColumn("ed", F.col("ed").cast("date"))


@query(f"with {EVENT_SQL}, o as (select o_orderkey, cast(o_orderdate as date) as d from orders), j as (select o.*, ev.name, ev.ed, row_number() over (partition by o.o_orderkey order by ev.pr, ev.ed) as r from o left join ev on o.d between ev.ed - interval 3 day and ev.ed + interval 3 day) select o_orderkey, d, name, ed from j where r = 1")
def event_window_first_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return R.event_windows(o, events(spark), "d", "ed", 3, 3, ["name"], [F.col("pr"), F.col("ed")]).select("o_orderkey", "d", "name", "ed")


@query(f"with {EVENT_SQL} select o_orderkey, cast(o_orderdate as date) as d from orders where not exists (select 1 from ev where abs(datediff('day', ev.ed, cast(o_orderdate as date))) <= 5)")
def exclusion_anti_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return R.exclude_neighbourhood(o, events(spark), "d", "ed", 5)


@query(f"with {EVENT_SQL}, {DAILY}, p as (select k, d as d0, lead(d) over (partition by k order by d) as d1 from daily) select k, d0, d1 from p where exists (select 1 from ev where ev.ed > p.d0 and ev.ed <= p.d1)")
def event_between_pairs(spark, sf_dir):
    p = R.pairs_within(daily(spark, sf_dir), ["k"], "d", "v", 100000).select("k", "d0", "d1")
    return R.with_event_between(p, events(spark), "d0", "d1", "ed")


@query(f"with {DAILY} select k, d, v, lead(d, 5) over w as d_ahead, lead(v, 5) over w as v_ahead from daily window w as (partition by k order by d)")
def business_day_ahead(spark, sf_dir):
    return R.ahead_on_calendar(daily(spark, sf_dir), ["k"], "d", 5, ["v"], "_ahead").select("k", "d", "v", "d_ahead", "v_ahead")


@query(f"with {DAILY}, p as (select k, d as d0, v as v0, lead(d) over w as d1, lead(v) over w as v1 from daily window w as (partition by k order by d)) select * from p where datediff('day', d0, d1) <= 2")
def bounded_gap_pairs(spark, sf_dir):
    return R.pairs_within(daily(spark, sf_dir), ["k"], "d", "v", 2)


@query(f"with {DAILY}, x as (select k, date_trunc('month', d)::date as m, dayofmonth(d) as x, v as y from daily), s as (select a.k, a.m, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) as slope from x a join x b on a.k = b.k and a.m = b.m and b.x > a.x group by 1, 2) select x.k, x.m, round(any_value(s.slope) + 3e-7, 4) as slope, round(quantile_cont(x.y - s.slope * x.x, 0.5) + 3e-7, 4) as intercept, count(*) as n from x join s on x.k = s.k and x.m = s.m group by 1, 2")
def theil_sen_every_month(spark, sf_dir):
    d = daily(spark, sf_dir).select("k", F.trunc("d", "month").alias("m"), F.dayofmonth("d").alias("x"), F.col("v").alias("y"))
    t = R.theil_sen(d, ["k", "m"], "x", "y")
    return t.select("k", "m", F.round(F.col("slope") + 3e-7, 4).alias("slope"), F.round(F.col("intercept") + 3e-7, 4).alias("intercept"), "n")


@query("""with o as (select cast(o_orderdate as date) as d, avg(case when o_orderstatus = 'F' then o_totalprice end) as a, avg(case when o_orderstatus <> 'F' then o_totalprice end) as b from orders group by 1),
old as (select d, a as v from o where d < date '1996-06-01' and a is not null), new as (select d, b as v from o where d >= date '1995-01-01' and b is not null),
r as (select quantile_cont(new.v / old.v, 0.5) as r, count(*) as k from old join new using (d)), f as (select min(d) as f from new)
select old.d, round(old.v * r.r, 5) as v, 'old' as segment from old, r, f where r.k >= 20 and old.d < f.f union all select d, round(v, 5) as v, 'new' as segment from new""")
def splice_rescale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"), F.avg(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))).alias("b"))
    old = o.where("d < date'1996-06-01' and a is not null").select("d", F.col("a").alias("v"))
    new = o.where("d >= date'1995-01-01' and b is not null").select("d", F.col("b").alias("v"))
    return R.splice(old, new, "d", "v").select("d", F.round("v", 5).alias("v"), "segment")


@query("""with x as (select user_id, cast(ts as date) as d, arg_max(value, (ts, event_id)) as v from events group by 1, 2), b as (select user_id, min(d) as a, max(d) as z from x group by 1),
s as (select user_id, cast(unnest(generate_series(a, z, interval 1 day)) as date) as d from b), j as (select s.user_id, s.d, x.v from s left join x using (user_id, d))
select user_id, d, round(v, 6) as v, round(last_value(v ignore nulls) over w, 6) as v_filled, last_value(case when v is not null then d end ignore nulls) over w as v_asof from j window w as (partition by user_id order by d rows between unbounded preceding and current row)""")
def ffill_spine(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    x = A.last_per_group(e, ["user_id", "d"], ["ts", "event_id"], ["value"]).withColumnRenamed("value", "v")
    d = W.forward_fill(R.spine(x, ["user_id"], "d"), ["user_id"], "d", ["v"])
    return d.select("user_id", "d", F.round("v", 6).alias("v"), F.round("v_filled", 6).alias("v_filled"), "v_asof")


@query("""with f as (select l_orderkey as k, l_linenumber as issued, l_extendedprice as f, row_number() over (partition by l_orderkey order by l_linenumber desc, l_extendedprice) as r from lineitem)
select f.k as o_orderkey, f.issued, round(o_totalprice - f.f, 2) as error from f join orders on o_orderkey = f.k where r = 1""")
def forecast_actual_join(spark, sf_dir):
    """The latest forecast of each target with its actual."""
    from pyspark.sql import Window

    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber").desc(), "l_extendedprice")
    f = li.select("l_orderkey", "l_linenumber", "l_extendedprice").withColumn("r", F.row_number().over(w)).where("r = 1")
    return f.join(o, f["l_orderkey"] == o["o_orderkey"]).select("o_orderkey", F.col("l_linenumber").alias("issued"), F.round(F.col("o_totalprice") - F.col("l_extendedprice"), 2).alias("error"))


@query(f"with {DAILY} select a.d, round(a.v - b.v, 2) as diff, a.n + b.n as n from daily a join daily b on a.d = b.d where a.k = '1-URGENT' and b.k = '5-LOW'")
def champion_challenger_days(spark, sf_dir):
    d = daily(spark, sf_dir)
    a, b = d.where("k = '1-URGENT'"), d.where("k = '5-LOW'").select("d", F.col("v").alias("w"), F.col("n").alias("m"))
    return a.join(b, "d").select("d", F.round(F.col("v") - F.col("w"), 2).alias("diff"), (F.col("n") + F.col("m")).alias("n"))


@query("select n.n_name, r.r_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer left join nation n on c_nationkey = n_nationkey left join region r on n_regionkey = r_regionkey group by 1, 2")
def dimension_left_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"""with {DAILY}, e as (select event_type as k, cast(ts as date) as d from events group by 1, 2)
select 'only_orders' as side, count(*) as n from (select d from daily except select d from e) union all select 'both', count(*) from (select d from daily intersect select d from e) union all select 'all', count(*) from (select d from daily union select d from e)""")
def date_set_operations(spark, sf_dir):
    a, b = daily(spark, sf_dir).select("d"), table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"))
    parts = [("only_orders", a.subtract(b)), ("both", a.intersect(b)), ("all", a.union(b).distinct())]
    out = None
    for name, p in parts:
        one = p.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select o_orderkey, cast(o_orderdate as date) as d, (extract(isodow from o_orderdate) - 1)::int as wd, date_trunc('week', o_orderdate)::date as week,
(select count(*) from generate_series(cast(o_orderdate as date) + 1, cast(o_orderdate as date) + 10, interval 1 day) g(x) where extract(isodow from x) < 6)::int as bdays,
(month(o_orderdate) * 100 + day(o_orderdate) >= 1101 or month(o_orderdate) * 100 + day(o_orderdate) <= 115) as season from orders""")
def scalar_calendar(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return d.select("o_orderkey", "d", S.weekday0("d").alias("wd"), S.week_of("d").alias("week"), S.business_days_since("d", F.date_add("d", 10)).alias("bdays"), S.in_season("d", (11, 1), (1, 15)).alias("season"))
