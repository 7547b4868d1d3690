"""Predicates, scalar functions, series operators and demotion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import predicates as P
from tidemark.operators import series as L
from tidemark.plans import demotion as D
from tidemark.sources.readers import table
from tidemark.suites import DAILY, daily, query

BY = "partition by k order by d"
NOW = "1998-06-01 00:00:00"
EV = "ev as (select distinct cast(o_orderdate as date) as ed from orders where o_totalprice > 440000)"


def r(c, n=6):
    return F.round(c, n)


def big_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 440000").select(F.to_date("o_orderdate").alias("ed")).distinct()


@query(f"with {DAILY}, x as (select k, d, v, case when n > 1 then n end as n from daily), t as (select k, max(d) as d from x group by 1) select x.* from x join t using (k, d) where n is not null")
def last_complete_rows(spark, sf_dir):
    x = daily(spark, sf_dir).withColumn("n", F.when(F.col("n") > 1, F.col("n"))).select("k", "d", "v", "n")
    return P.last_complete(x, ["k"], "d", ["n"])


@query(f"with {DAILY} select k, d, v from daily where n is not null and d >= date '1995-01-01' and d < date '1996-01-01' and cast(v as varchar) is not null")
def sub_period_rows(spark, sf_dir):
    return P.complete(P.sub_period(daily(spark, sf_dir), "d", "1995-01-01", "1996-01-01"), ["v"]).select("k", "d", "v")


@query(f"select o_orderpriority as cause, count(*) as n from orders where o_orderdate >= timestamp '{NOW}' - interval 30 day and o_orderdate <= timestamp '{NOW}' group by 1")
def causes_in_window(spark, sf_dir):
    return L.causes(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "cause"), "cause", "o_orderdate", 30, F.lit(NOW).cast("timestamp"))


@query("select event_id, ts from events where ts >= (select max(ts) from events) - interval 2 day")
def trailing_newest_rows(spark, sf_dir):
    return P.trailing_newest(table(spark, sf_dir, "events"), "ts", 2).select("event_id", "ts")


@query(f"with {DAILY}, x as (select k, d, floor(v / 100000) as v, n = 1 as filled from daily), y as (select *, lag(v) over ({BY}) as p from x) select k, d, coalesce(v <> p, v is not null) as own, coalesce(v <> p, v is not null) and not filled as own_given, coalesce(isodow(d) >= 6 and v = p, false) as carried from y")
def genuine_rows(spark, sf_dir):
    x = daily(spark, sf_dir).select("k", "d", F.floor(F.col("v") / 100000).alias("v"), (F.col("n") == 1).alias("filled"))
    return x.select("k", "d", P.genuine(["k"], "d", "v").alias("own"), P.genuine(["k"], "d", "v", "filled").alias("own_given"), P.weekend_carry(["k"], "d", "v").alias("carried"))


@query("with x as (select o_orderkey, case when o_orderkey % 3 = 0 then true when o_orderkey % 3 = 1 then false end as retro, o_totalprice - 100000 as a, o_totalprice as b from orders) select o_orderkey, coalesce(not retro, false) as strict_live, coalesce(not retro, true) as loose_live, a > 0 and b > 0 as valid from x")
def live_and_valid(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, True).when(k == 1, False).alias("retro"), (F.col("o_totalprice") - 100000).alias("a"), F.col("o_totalprice").alias("b"))
    return x.select("o_orderkey", P.live_only("retro").alias("strict_live"), P.live_only("retro", False).alias("loose_live"), P.valid_fold("a", "b").alias("valid"))


@query(f"with {DAILY}, x as (select k, d, v, row_number() over ({BY}) as i from daily) select k, d, v from x where (i - 1) % 5 = 0 and v > 0")
def every_fifth(spark, sf_dir):
    return P.every_kth(P.must_be_positive(daily(spark, sf_dir), "v"), ["k"], "d", 5).select("k", "d", "v")


@query(f"with {DAILY}, x as (select k, d, v as raw, case when n >= 3 then n * 1000.0 end as derived from daily), g as (select k, count(derived) >= 40 or arg_max(derived is not null, d) as use from x group by 1) select k, d, case when use then derived else raw end as shown from x join g using (k)")
def chart_choice(spark, sf_dir):
    x = daily(spark, sf_dir).select("k", "d", F.col("v").alias("raw"), F.when(F.col("n") >= 3, F.col("n") * 1000.0).alias("derived"))
    return P.chart_series(x, ["k"], "d", "raw", "derived", 40).select("k", "d", "shown")


@query("select event_id, round(value * exp(-0.01), 6) as low, round(value * exp(0.02), 6) as high, sign(value - 50) * sign(value - 40) > 0 as agrees, floor(value + 0.5)::bigint as half_up, cast(floor(10 * value + 1e-9) as int) as tens, round(value - 1.645 * 2, 6) as band_low, round((value + 3.0) / (2 * 1.6448536269514722), 6) as sd from events where value is not null")
def scalar_bands(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("zero", F.lit(-3.0)).withColumn("two", F.lit(2.0))
    low, high = S.price_bounds("value", F.lit(-0.01), F.lit(0.02))
    return e.select("event_id", r(low).alias("low"), r(high).alias("high"), S.sign_agrees(F.col("value") - 50, F.col("value") - 40).alias("agrees"), S.round_half_up("value").alias("half_up"), S.times_of_ten("value").alias("tens"), r(S.normal_bounds("value", "two", 1.645)[0]).alias("band_low"), r(S.implied_sd("zero", "value")).alias("sd"))


@query("""with x as (select event_id, value, case event_id % 4 when 0 then '12.5' when 1 then 'x1' when 2 then '-7' else '1,234' end as t from events)
select event_id, case when regexp_matches(t, '^-?[0-9]+(\\.[0-9]+)?$') then t::double end as number, case when event_id % 4 <> 1 then replace(regexp_extract(t, '(-?[0-9,.]+)', 1), ',', '')::double when event_id % 4 = 1 then 1.0 end as first_number,
case when regexp_matches(t, '^[0-9]+$') then t::double end as wait, round(1 / (1 + exp(-greatest(-40, least(40, value / 10)))), 9) as squashed, round(ln(greatest(1e-6, least(1 - 1e-6, value / 200)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 200)))), 6) as log_odds, least(60.0, pow(2.0, event_id % 10)) as pause, round(pow(0.5, (event_id % 10) / 3.0), 9) as weight, event_id % 4 <> 1 as plain from x where value is not null""")
def scalar_text(spark, sf_dir):
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("t", F.when(k == 0, "12.5").when(k == 1, "x1").when(k == 2, "-7").otherwise("1,234"))
    ten = F.col("event_id") % 10
    return e.select("event_id", S.strict_number("t").alias("number"), S.regex_number("t", r"(-?[0-9,.]+)").alias("first_number"), S.retry_after("t", F.lit(NOW)).alias("wait"), r(S.sigmoid(F.col("value") / 10), 9).alias("squashed"), r(S.logit(F.col("value") / 200)).alias("log_odds"), S.backoff(ten).alias("pause"), r(S.recency_weight(ten, 3.0), 9).alias("weight"), S.lookup(F.col("t"), {"x1": False}, True).alias("plain"))


@query("""with x as (select o_orderkey, o_totalprice / 1e7 as v, cast(o_orderdate as date) as d from orders)
select o_orderkey, round(5 * (0.02 / (1 - 0.95)) + (v - 0.02 / (1 - 0.95)) * ((1 - pow(0.95, 5)) / (1 - 0.95)), 9) as variance, case when month(d) * 100 + day(d) >= 1015 or month(d) * 100 + day(d) <= 115 then true else false end as season, d + interval 570 minute as opens, greatest(d, date '1995-01-01') as known, isodow(d) - 1 as weekday from x""")
def scalar_moments(spark, sf_dir):
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders")
    opens = S.local_moment(d, "15:00", "Asia/Kolkata").cast("timestamp_ntz")
    return o.select("o_orderkey", r(S.garch_variance(F.col("o_totalprice") / 1e7, 0.02, 0.05, 0.9, 5), 9).alias("variance"), S.in_season(d, (10, 15), (1, 15)).alias("season"), opens.alias("opens"), S.known_at(d, F.lit("1995-01-01").cast("date")).alias("known"), S.weekday0(d).cast("long").alias("weekday"))


@query(f"with {DAILY} select k, d, lag(v) over w as lag_1, lag(v, 4) over w as lag_4, round(v - lag(v) over w, 6) as step, round(lead(v) over w - v, 6) as target_delta from daily window w as ({BY})")
def row_lag_features(spark, sf_dir):
    d = L.lag_features(daily(spark, sf_dir), ["k"], "d", "v", (1, 4))
    return d.select("k", "d", "lag_1", "lag_4", r("step").alias("step"), r("target_delta").alias("target_delta"))


@query(f"with {DAILY}, b as (select *, coalesce(datediff('day', lag(d) over ({BY}), d) > 2, false)::int as b from daily), s as (select *, sum(b) over ({BY}) as s from b), m as (select k, max(s) as s from s group by 1) select k, d, v from s join m using (k, s)")
def most_recent_run(spark, sf_dir):
    return L.latest_run(daily(spark, sf_dir), ["k"], "d", 2).select("k", "d", "v")


@query(f"with {DAILY}, a as (select *, datediff('day', date '1970-01-01', d) as i, datediff('day', date '1969-12-29', d) as m from daily), b as (select *, (m // 7) * 5 + least(m % 7, 5) as wd from a), c as (select *, sum(coalesce(wd - prev > 2, false)::int) over (partition by k order by i) as run from (select *, lag(wd) over (partition by k order by i) as prev from b)), x as (select *, max(d) over (partition by k, run) as newest from c), y as (select k, d, newest, min(v) over w as lo, max(v) over w as hi, count(v) over w as n from x window w as (partition by k order by i range between 1 following and 7 following)) select k, d, case when ok then lo end as path_min, case when ok then hi end as path_max, case when ok then n end as path_n from (select *, datediff('day', d, newest) > 7 and n > 0 as ok from y)")
def forward_week(spark, sf_dir):
    return L.forward_window(daily(spark, sf_dir), ["k"], "d", "v").select("k", "d", "path_min", "path_max", "path_n")


@query(f"with {DAILY}, u as (select k, d, (v > 250000)::int as up from daily), s as (select k, d, case when count(up) over w = 20 then avg(up) over w end as s from u window w as ({BY} rows between 19 preceding and current row)) select k, d, round(s, 9) as up_share, s <= 0.4 or s >= 0.6 as collapsed from s")
def up_share_collapse(spark, sf_dir):
    x = daily(spark, sf_dir).withColumn("up", (F.col("v") > 250000).cast("int"))
    return L.collapsed(x, ["k"], "d", "up", 20, 0.4).select("k", "d", r("up_share", 9).alias("up_share"), "collapsed")


@query(f"with {DAILY}, a as (select d, case when n > 1 then v end as a from daily where k = '1-URGENT'), b as (select d, v as b from daily where k = '5-LOW') select d, a, b from a full join b using (d) where a is not null and b is not null")
def aligned_series(spark, sf_dir):
    d = daily(spark, sf_dir)
    a = d.where("k = '1-URGENT'").select("d", F.when(F.col("n") > 1, F.col("v")).alias("a"))
    return L.aligned(a, d.where("k = '5-LOW'").select("d", F.col("v").alias("b")), ["d"], ["a", "b"])


@query(f"with {DAILY} select a.k, a.d, b.v as v_lag from daily a left join daily b on a.k = b.k and b.d = a.d - interval 1 day")
def calendar_day_back(spark, sf_dir):
    d = daily(spark, sf_dir).select("k", "d", "v")
    return L.days_back(d, d, ["k"], "d", ["v"]).select("k", "d", "v_lag")


@query(f"with {DAILY}, b as (select *, coalesce(datediff('day', lag(d) over ({BY}), d) > 3, false)::int as b from daily), s as (select *, sum(b) over ({BY}) as s from b), t as (select k, d, v as base, lead(v, 2) over (partition by k, s order by d) as actual from s) select k, d, base, actual, round(abs(n * 90000.0 - actual), 4) as error from t join daily using (k, d) where actual is not null")
def rescored_forecasts(spark, sf_dir):
    d = daily(spark, sf_dir)
    f = d.select("k", "d", (F.col("n") * 90000.0).alias("f"))
    return L.rescored(f, d.select("k", "d", "v"), ["k"], "d", "f", "v", 2, 3).select("k", "d", "base", "actual", r("error", 4).alias("error"))


@query(f"with {EV} select o_orderkey, coalesce((select min(datediff('day', cast(o_orderdate as date), ed)) from ev where ed >= cast(o_orderdate as date)), 9999) as days_to_next, coalesce((select min(datediff('day', ed, cast(o_orderdate as date))) from ev where ed <= cast(o_orderdate as date)), 9999) as days_since_last from orders")
def days_around_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return L.event_distances(o, big_days(spark, sf_dir), "d", "ed").select("o_orderkey", F.col("days_to_next").cast("long").alias("days_to_next"), F.col("days_since_last").cast("long").alias("days_since_last"))


@query("select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2 having count(*) >= 5")
def groups_with_support(spark, sf_dir):
    return L.groups_of(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 5)


@query("select event_type, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from events group by 1")
def value_shares(spark, sf_dir):
    return L.value_counts(table(spark, sf_dir, "events"), "event_type").withColumn("share", r("share", 9))


def _bin(x):
    return f"case when {x} >= 0 and {x} < 100000 then 0 when {x} >= 100000 and {x} < 200000 then 1 when {x} >= 200000 and {x} < 400000 then 2 end"


@query(f"with {DAILY}, p as (select year(d) as y, v as a, lag(v) over ({BY}) as b from daily), x as (select y, {_bin('a')} as a, {_bin('b')} as b from p) select y, count(*) as n, round(avg((a = b)::int), 9) as agreement from x where a is not null and b is not null group by 1")
def binned_agreement(spark, sf_dir):
    x = daily(spark, sf_dir).select(F.year("d").alias("y"), F.col("v").alias("a"), F.lag("v").over(Window.partitionBy("k").orderBy("d")).alias("b"))
    return L.bucket_agreement(x, ["y"], "a", "b", [0, 100000, 200000, 400000]).withColumn("agreement", r("agreement", 9))


@query(f"with {DAILY}, x as (select k, year(d) as y, v as base, lead(v) over ({BY}) as actual, n * 90000.0 as f from daily) select k, y, count(actual) as resolved, round(avg(abs(f - actual)), 4) as mae, round(avg(case when actual is not null and actual <> base then (sign(f - base) = sign(actual - base))::int end), 9) as direction from x where k = '2-HIGH' group by 1, 2")
def decision_scores(spark, sf_dir):
    x = daily(spark, sf_dir).select("k", F.year("d").alias("y"), F.col("v").alias("base"), F.lead("v").over(Window.partitionBy("k").orderBy("d")).alias("actual"), (F.col("n") * 90000.0).alias("f"))
    return L.decision_metrics(L.variant(x, "k", "2-HIGH"), ["k", "y"], "f", "base", "actual").withColumn("mae", r("mae", 4)).withColumn("direction", r("direction", 9))


LOWER = "list_sum(list_transform(range(0, k2::bigint + 1), lambda j: exp(lgamma(n2 + 1) - lgamma(j + 1) - lgamma(n2 - j + 1) + j * ln(0.55) + (n2 - j) * ln(0.45))))"


@query(f"""with {DAILY}, f as (select k, d, v as a, lead(v) over ({BY}) as b, n from daily), h as (select k, d, case when b <> a then ((n > 1) = (b > a))::int end as hit from f),
w as (select k, d, count(hit) over x as n2, coalesce(sum(hit) over x, 0) as k2 from h window x as ({BY} rows between 59 preceding and current row)), p as (select k, d, case when n2 >= 30 then least(1.0, {LOWER}) end as p from w),
t as (select *, coalesce(p < 0.05, false) as breach from p), c as (select *, count(*) over x = 3 and min(breach::int) over x = 1 as t from t window x as ({BY} rows between 2 preceding and current row))
select k, d, round(p, 7) as breach_p, breach, bool_or(t) over ({BY} rows between unbounded preceding and current row) as demoted from c""")
def direction_demotion(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    f = daily(spark, sf_dir).withColumn("b", F.lead("v").over(w))
    f = f.withColumn("hit", F.when(F.col("b") != F.col("v"), ((F.col("n") > 1) == (F.col("b") > F.col("v"))).cast("int")))
    d = D.demoted(D.rate_breach(f, ["k"], "d", "hit", 60, 0.55), ["k"], "d")
    return d.select("k", "d", r("breach_p", 7).alias("breach_p"), "breach", "demoted")


@query(f"""with {DAILY}, x as (select k, d, (abs(v - 230000) - abs(v - 250000)) / 1000 as z, row_number() over ({BY}) as i from daily), w as (select a.k, a.d, count(*) as n, list(b.z order by b.i) as l from x a join x b on a.k = b.k and b.i <= a.i and b.i > a.i - 40 group by 1, 2),
c as (select k, d, n, list_avg(l) as m, list_inner_product(l, l) / n as sq, list_transform(l, lambda e: e - list_avg(l)) as c from w),
v as (select k, d, n, m, sq, (list_sum(list_transform(c, lambda e: e * e)) + 2 * coalesce(list_sum(list_transform(range(1, 5), lambda g: (1 - g / 5.0) * coalesce(list_sum(list_transform(range(g + 1, n + 1), lambda j: c[j] * c[j - g])), 0))), 0)) / n as var from c),
t as (select v.*, n >= 30 and var <= 1e-12 * sq as still from v), s as (select k, d, m, still, case when n >= 30 and not still then m / sqrt(case when var > 0 then var end / n) end as stat from t),
p as (select *, case when still then case when m > 0 then 0.0 else 1.0 end else (1 - stat / sqrt(stat * stat + 4) * (1 + 2 / (stat * stat + 4))) / 2 end as p from s)
select k, d, round(stat, 6) as stat, round(p, 6) as p_worse, coalesce(m > 0 and p < 0.05, false) as breach from p""")
def error_demotion_statistic(spark, sf_dir):
    v = F.col("v")
    x = daily(spark, sf_dir).withColumn("z", (F.abs(v - 230000) - F.abs(v - 250000)) / 1000)
    return D.error_breach(x, ["k"], "d", "z").select("k", "d", r("stat").alias("stat"), r("p_worse", 6).alias("p_worse"), "breach")
