"""Windows, segments and walk-forward bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import windows as W
from tidemark.plans import walkforward as P
from tidemark.sources.readers import table
from tidemark.suites import DAILY, daily, query

BY = "partition by k order by d"


def r(c, n=4):
    return F.round(c, n)


@query("""with w as (select event_id, user_id, value, epoch_us(ts) as u from events)
select event_id, round(avg(value) over f, 6) as r_mean, round(coalesce(stddev_samp(value) over f, 0), 6) as r_std, round(min(value) over f, 6) as r_min, round(max(value) over f, 6) as r_max, count(value) over f as r_n
from w window f as (partition by user_id order by u range between 604799999999 preceding and current row)""")
def rolling_7d_open(spark, sf_dir):
    d = W.rolling(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 7)
    return d.select("event_id", r("r_mean", 6).alias("r_mean"), r("r_std", 6).alias("r_std"), r("r_min", 6).alias("r_min"), r("r_max", 6).alias("r_max"), "r_n")


@query(f"with {DAILY}, x as (select *, case when datediff('day', lag(d) over ({BY}), d) > 1 then 1 else 0 end as b from daily) select k, d, cast(sum(b) over ({BY}) as bigint) as segment from x")
def islands_gap(spark, sf_dir):
    return W.gap_segments(daily(spark, sf_dir), ["k"], "d", 1).select("k", "d", "segment")


@query("""with e as (select user_id, ts, max(event_type) as event_type from events group by 1, 2), x as (select *, case when event_type is distinct from lag(event_type) over w and lag(ts) over w is not null then 1 else 0 end as b from e window w as (partition by user_id order by ts)),
y as (select *, sum(b) over (partition by user_id order by ts) as g from x) select user_id, any_value(event_type) as event_type, min(ts) as run_start, max(ts) as run_end, count(*) as run_length from y group by user_id, g""")
def run_length(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_type").alias("event_type"))
    return W.run_lengths(e, ["user_id"], "ts", "event_type")


@query(f"with {DAILY}, x as (select *, case when v - lag(v) over ({BY}) <= -20000 then 1 else 0 end as e from daily), y as (select *, sum(e) over ({BY}) as i from x) select k, d, cast(sum(1 - e) over (partition by k, i order by d) as bigint) as since_drop from y")
def since_last_drop(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    x = daily(spark, sf_dir).withColumn("drop", F.col("v") - F.lag("v").over(w) <= -20000)
    return W.rows_since(x, ["k"], "d", F.col("drop"), "since_drop").select("k", "d", "since_drop")


@query(f"with {DAILY}, x as (select *, list(v) over ({BY} rows between 90 preceding and 1 preceding) as p from daily) select k, d, case when len(p) > 0 then round(len(list_filter(p, lambda y: y <= v)) / len(p), 6) end as pct_rank from x")
def trailing_percentile_rank(spark, sf_dir):
    return W.trailing_rank(daily(spark, sf_dir), ["k"], "d", "v", 90).select("k", "d", r("pct_rank", 6).alias("pct_rank"))


@query(f"""with {DAILY}, x as (select *, list(v) over w as p, quantile_cont(v, 0.5) over w as m from daily window w as ({BY} rows between 60 preceding and 1 preceding)),
y as (select *, case when len(p) > 0 then list_aggregate(list_transform(p, lambda q: abs(q - m)), 'quantile_cont', 0.5) end as mad from x) select k, d, case when len(p) >= 20 and mad > 0 then round((v - m) / (1.4826 * mad), 4) end as robust_z from y""")
def robust_trailing_z(spark, sf_dir):
    return W.robust_z(daily(spark, sf_dir), ["k"], "d", "v", 60, 20).select("k", "d", r("robust_z").alias("robust_z"))


@query(f"with {DAILY}, x as (select *, list(v) over ({BY} rows between 1 following and 10 following) as p from daily) select k, d, case when len(p) = 10 then coalesce(list_filter(p, lambda y: y <= v * 0.9)[1], p[10]) end as fill from x")
def first_hit_forward(spark, sf_dir):
    return W.first_hit(daily(spark, sf_dir), ["k"], "d", "v", F.col("v") * 0.9, 10).select("k", "d", "fill")


@query(f"""with {DAILY}, x as (select *, case when datediff('day', d, lead(d) over ({BY})) <= 2 then 1 when lead(d) over ({BY}) is not null then 0 end as ok from daily),
y as (select *, count(ok) over s = 5 and min(ok) over s = 1 as whole, lead(v, 5) over ({BY}) as e, min(v) over a as lo, max(v) over a as hi from x window s as ({BY} rows between current row and 4 following), a as ({BY} rows between 1 following and 5 following))
select k, d, case when whole then e end as end_5, case when whole then lo end as path_min_5, case when whole then hi end as path_max_5 from y""")
def path_chain_5(spark, sf_dir):
    return W.chain_ahead(daily(spark, sf_dir), ["k"], "d", "v", 5, 2).select("k", "d", "end_5", "path_min_5", "path_max_5")


@query(f"with {DAILY}, x as (select k, d, n, lag(n) over ({BY}) as p, row_number() over ({BY}) as f from daily) select k, d, n from x where f = 1 or n is distinct from p")
def drop_carried_forward(spark, sf_dir):
    return W.drop_repeats(daily(spark, sf_dir), ["k"], "d", "n").select("k", "d", "n")


@query(f"with {DAILY}, x as (select *, row_number() over ({BY}) as i from daily) select a.k, a.d, round(sum(b.v * pow(0.5, (a.i - b.i - 1) / 10.0)) / sum(pow(0.5, (a.i - b.i - 1) / 10.0)), 3) as ewma from x a left join x b on a.k = b.k and b.i < a.i group by 1, 2")
def ewma_shifted(spark, sf_dir):
    return W.ewma(daily(spark, sf_dir), ["k"], "d", "v", 10, "ewma").select("k", "d", r("ewma", 3).alias("ewma"))


@query(f"with {DAILY}, x as (select *, case when abs(ln(v / lag(v) over ({BY}))) > 0.6 then ln(v / lag(v) over ({BY})) else 0 end as j from daily) select k, d, round(ln(v * exp(coalesce(sum(j) over ({BY} rows between 1 following and unbounded following), 0))), 8) as adjusted from x")
def back_adjusted_history(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    jump = F.coalesce(F.abs(F.ln(F.col("v") / F.lag("v").over(w))) > 0.6, F.lit(False))
    d = daily(spark, sf_dir).withColumn("jump", jump)
    return W.back_adjust(d, ["k"], "d", "v", F.col("jump")).select("k", "d", r(F.ln("adjusted"), 8).alias("adjusted"))


@query(f"with {DAILY} select a.k, a.d, round(a.v - b.v, 2) as change_7 from daily a left join daily b on a.k = b.k and a.d = b.d + 7")
def seasonal_change_7(spark, sf_dir):
    return W.seasonal_change(daily(spark, sf_dir), ["k"], "d", "v", 7, "c").select("k", "d", r("c", 2).alias("change_7"))


@query("""with e as (select event_id, user_id, value, epoch_us(ts) as u, ts from events) select event_id, round(last_value(value) over w - first_value(value) over w, 6) as momentum from e window w as (partition by user_id order by u, event_id rows between 9 preceding and current row)""")
def momentum_last_ten(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(W.micros("ts"), "event_id").rowsBetween(-9, 0)
    return table(spark, sf_dir, "events").select("event_id", r(F.last("value").over(w) - F.first("value").over(w), 6).alias("momentum"))


@query(f"with {DAILY}, x as (select *, lag(v) over ({BY}) as f from daily), y as (select *, abs(v - f) as e from x), z as (select *, case when count(e) over w >= 20 then quantile_cont(e, 0.8) over w end as h from y window w as ({BY} rows between 60 preceding and 1 preceding)) select k, d, round(h, 3) as half_width, round(f - h, 3) as lower, round(f + h, 3) as upper from z")
def conformal_band_walk_forward(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = P.conformal_band(daily(spark, sf_dir).withColumn("f", F.lag("v").over(w)), ["k"], "d", "f", "v")
    return d.select("k", "d", r("half_width", 3).alias("half_width"), r("lower", 3).alias("lower"), r("upper", 3).alias("upper"))


RET = f"{DAILY}, ret as (select k, d, ln(v / lag(v) over ({BY})) as y, ln(lag(v) over ({BY}) / lag(v, 2) over ({BY})) as x, lead(d) over ({BY}) as known from daily)"


def returns(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    v = F.col("v")
    return daily(spark, sf_dir).select("k", "d", F.ln(v / F.lag(v).over(w)).alias("y"), F.ln(F.lag(v).over(w) / F.lag(v, 2).over(w)).alias("x"), F.lead("d").over(w).alias("known"))


@query(f"""with {RET}, s as (select a.k, a.d, a.x, sum(b.x * b.x) as xx, sum(b.x * b.y) as xy, count(case when b.x * b.y is not null then 1 end) as n from ret a left join ret b on a.k = b.k and b.known <= a.d group by 1, 2, 3)
select k, d, case when n >= 30 and xx > 0 then round(xy / xx, 7) end as slope, case when n >= 30 and xx > 0 then round(xy / xx * x, 7) end as forecast from s""")
def expanding_slope(spark, sf_dir):
    d = P.slope_forecast(returns(spark, sf_dir), ["k"], "d", "known", "x", "y")
    return d.select("k", "d", r("slope", 7).alias("slope"), r("forecast", 7).alias("forecast"))


@query(f"with {RET} select k, d, case when count(x * y) over w >= 30 and sum(case when x * y is not null then x * x end) over w > 0 then round(sum(x * y) over w / sum(case when x * y is not null then x * x end) over w, 7) end as slope from ret window w as ({BY} rows between 60 preceding and 1 preceding)")
def roll60_slope(spark, sf_dir):
    return P.rolling_slope(returns(spark, sf_dir), ["k"], "d", "x", "y").select("k", "d", r("slope", 7).alias("slope"))


@query(f"""with {DAILY}, x as (select k, d, v as y, cast(n as double) as x, row_number() over ({BY}) as i from daily), s as (select a.k, a.d, count(b.i) as n, sum(w) as sw, sum(w * b.x) as sx, sum(w * b.y) as sy, sum(w * b.x * b.x) as sxx, sum(w * b.x * b.y) as sxy from x a left join (select *, 1 as one from x) b on a.k = b.k and b.i < a.i, lateral (select pow(2.0, (b.i - a.i) / 10.0) as w) group by 1, 2)
select k, d, case when n >= 30 and (sw * sxx - sx * sx) / (sw * sw) > 1e-9 then round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 2) end as slope from s""")
def expanding_ols_recency(spark, sf_dir):
    x = daily(spark, sf_dir).select("k", "d", F.col("v").alias("y"), F.col("n").cast("double").alias("x"))
    return P.recency_fit(x, ["k"], "d", "x", "y").select("k", "d", r("slope", 2).alias("slope"))


@query(f"""with {DAILY}, x as (select *, count(v) over a = 5 as whole, ln(min(v) over a / v) as lo, ln(max(v) over a / v) as hi from daily window a as ({BY} rows between 1 following and 5 following)),
y as (select k, d, case when whole then lo end as lo, case when whole then hi end as hi from x) select k, d, case when count(lo) over p >= 30 then round(quantile_cont(lo, 0.1) over p, 5) end as range_low, case when count(lo) over p >= 30 then round(quantile_cont(hi, 0.9) over p, 5) end as range_high from y window p as ({BY} rows between 505 preceding and 5 preceding)""")
def path_range_5(spark, sf_dir):
    d = P.path_ranges(daily(spark, sf_dir), ["k"], "d", "v", 5)
    return d.select("k", "d", r("range_low", 5).alias("range_low"), r("range_high", 5).alias("range_high"))


@query(f"with {DAILY}, x as (select *, ln(v / lag(v) over ({BY})) as q from daily) select k, d, round(stddev_samp(q) over ({BY} rows between 19 preceding and current row), 8) as vol from x")
def realised_volatility(spark, sf_dir):
    return P.volatility_band(daily(spark, sf_dir), ["k"], "d", "v", 20, 1).select("k", "d", r("vol", 8).alias("vol"))


@query(f"with {DAILY}, x as (select *, lead(v) over ({BY}) - v as m from daily) select k, d, case when m > 5000 then 1 when m < -5000 then -1 when m is not null then 0 end as label3, case when m is not null then cast(m > 0 as int) end as label2, case when abs(m) > 5000 then cast(m > 0 as int) end as label_far from x")
def direction_labels(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("m", F.lead("v").over(Window.partitionBy("k").orderBy("d")) - F.col("v"))
    return P.labels(d, "m", 5000).select("k", "d", "label3", "label2", "label_far")


@query(f"with {DAILY}, x as (select k, d, case when n % 3 <> 0 then v end as c from daily) select k, d, round(coalesce(c, avg(c) over ({BY} rows between unbounded preceding and 1 preceding)) + 3e-7, 5) as c_imputed from x")
def mean_imputed_past(spark, sf_dir):
    d = daily(spark, sf_dir).select("k", "d", F.when(F.col("n") % 3 != 0, F.col("v")).alias("c"))
    return P.mean_imputed(d, ["k"], "d", "c").select("k", "d", r(F.col("c_imputed") + 3e-7, 5).alias("c_imputed"))


@query(f"with {DAILY}, f as (select *, lag(v) over ({BY}) as p, lag(v, 2) over ({BY}) as q from daily), g as (select k, d, v, p, q, avg(v) over ({BY} rows between 5 preceding and 1 preceding) as m from f) select k, d, case when p is not null and abs(p / m - 1) <= 0.12 then 'latest' when q is not null and coalesce(abs(q / m - 1) <= 0.12, true) then 'before' when m is not null then 'mean' end as source from g")
def tiered_source(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = daily(spark, sf_dir).select("k", "d", F.lag("v").over(w).alias("p"), F.lag("v", 2).over(w).alias("q"), F.avg("v").over(w.rowsBetween(-5, -1)).alias("m"))
    s = P.choose_source([("latest", F.col("p"), F.lit(True)), ("before", F.col("q"), F.lit(True)), ("mean", F.col("m"), F.lit(True))], F.col("m"))
    return d.select("k", "d", s["source"].alias("source"))


@query(f"with {DAILY}, m as (select a.k, a.d, sum(b.v) as s, count(b.v) as c from daily a left join daily b on a.k = b.k and b.d + 7 < a.d group by 1, 2) select k, d, round(coalesce(s, 0), 2) as past, c from m")
def matured_totals(spark, sf_dir):
    """Sums over rows whose label, a week later, was known strictly before."""
    d = daily(spark, sf_dir).withColumn("known", F.date_add("d", 7))
    out = P.matured_sums(d, ["k"], "d", "known", {"past": F.col("v"), "c": F.lit(1)})
    return out.select("k", "d", r("past", 2).alias("past"), F.col("c").cast("long").alias("c"))


@query(f"""with {DAILY}, b as (select k, d, v, min(v) over w as lo, max(v) over w as hi from daily window w as ({BY} rows between 20 preceding and 1 preceding)),
s as (select k, d + 1 as known, greatest(lo - v, v - hi) as s, row_number() over (partition by k order by d) as i from b where lo is not null), m as (select b.k, b.d, count(s.i) as m from b left join s on b.k = s.k and s.known < b.d group by 1, 2),
l as (select m.k, m.d, list_sort(list(s.s)) as l from m join s on m.k = s.k and s.i > m.m - 250 and s.i <= m.m group by 1, 2), q as (select k, d, case when len(l) >= 20 then l[least(ceil((len(l) + 1) * 0.8)::bigint, len(l))] end as adjust from l)
select b.k, b.d, round(adjust, 4) as adjust, round(lo - adjust, 4) as cqr_lower, round(hi + adjust, 4) as cqr_upper from b left join q on b.k = q.k and b.d = q.d""")
def cqr_bands(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = daily(spark, sf_dir).withColumn("lo", F.min("v").over(w.rowsBetween(-20, -1))).withColumn("hi", F.max("v").over(w.rowsBetween(-20, -1))).withColumn("known", F.date_add("d", 1))
    return P.cqr(d, ["k"], "d", "known", "lo", "hi", "v").select("k", "d", *[r(c, 4).alias(c) for c in ("adjust", "cqr_lower", "cqr_upper")])


@query(f"""with recursive {DAILY}, e as (select k, d, abs(v - lag(v) over ({BY})) as e, row_number() over ({BY}) as i from daily), x as (select a.k, a.d, a.i, a.e, list_sort(list(b.e) filter (b.e is not null)) as l from e a left join e b on a.k = b.k and b.i < a.i and b.i >= a.i - 60 group by all),
t as (select k, 0::bigint as i, 0.8::double as next, null::double as half, null::double as level from x where i = 1 union all
select k, i, case when half is not null and e is not null then level + 0.02 * (0.8 - (e <= half)::int) else level end as next, half, level from (
select k, i, e, level, case when len(l) >= 20 then l[floor(p)::bigint + 1] + (p - floor(p)) * (l[least(floor(p)::bigint + 2, len(l))] - l[floor(p)::bigint + 1]) end as half from (
select x.k, x.i, x.e, x.l, t.next as level, least(greatest(t.next, 0), 1) * (len(x.l) - 1) as p from t join x on x.k = t.k and x.i = t.i + 1)))
select t.k, x.d, round(t.half, 4) as aci_half, round(t.level, 9) as aci_level from t join x using (k, i)""")
def adaptive_conformal_bands(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("f", F.lag("v").over(Window.partitionBy("k").orderBy("d")))
    return P.adaptive_conformal(d, ["k"], "d", "f", "v").select("k", "d", r(F.nanvl("aci_half", F.lit(None).cast("double")), 4).alias("aci_half"), r("aci_level", 9).alias("aci_level"))


@query()
def huber_calibration(spark, sf_dir):
    return P.calibration(daily(spark, sf_dir).withColumn("x", F.col("n").cast("double")), ["k"], "d", "x", "v")


@query()
def garch_bounds(spark, sf_dir):
    from tidemark.plans.models import garch_forecast

    return garch_forecast(returns(spark, sf_dir), ["k"], "d", "y", 5)


@query()
def har_variance(spark, sf_dir):
    from tidemark.plans.models import har

    return har(returns(spark, sf_dir), ["k"], "d", "y", 5)


@query()
def simulated_range(spark, sf_dir):
    from tidemark.plans.models import simulated_ranges

    return simulated_ranges(returns(spark, sf_dir), ["k"], "d", "y", 5)


@query(f"""with recursive {DAILY}, x as (select k, d, v, case when n % 2 = 0 then lag(v) over ({BY}) end as w, row_number() over ({BY}) as i from daily),
t as (select k, 0::bigint as i, v as x0, 0::double as x1, 1e6::double as a, 0::double as b, 1e4::double as c from x where i = 1 union all
select k, i, case when w is null then y0 else y0 + (a1 + b1) / s * (w - y0 - y1) end, case when w is null then y1 else y1 + (b1 + c1) / s * (w - y0 - y1) end,
case when w is null then a1 else a1 - (a1 + b1) * (a1 + b1) / s end, case when w is null then b1 else b1 - (a1 + b1) * (b1 + c1) / s end, case when w is null then c1 else c1 - (b1 + c1) * (b1 + c1) / s end from (
select k, i, w, x0 + a0 / z * (v - x0) as y0, x1 + b / z * (v - x0) as y1, a0 - a0 * a0 / z as a1, b - a0 * b / z as b1, c - b * b / z as c1, a0 - a0 * a0 / z + 2 * (b - a0 * b / z) + c - b * b / z + 2e7 as s from (
select x.k, x.i, x.v, x.w, t.x0, t.x1, t.a + 1e6 as a0, t.b, t.c, t.a + 1e6 + 1e7 as z from t join x on x.k = t.k and x.i = t.i + 1)))
select t.k, x.d, round(t.x0, 3) as level, round(t.a, 2) as level_var from t join x using (k, i)""")
def kalman_levels(spark, sf_dir):
    from tidemark.plans.models import kalman

    w = Window.partitionBy("k").orderBy("d")
    d = daily(spark, sf_dir).withColumn("s2", F.when(F.col("n") % 2 == 0, F.lag("v").over(w)))
    return kalman(d, ["k"], "d", ["v", "s2"], 1e6, [1e7, 2e7]).select("k", "d", r("level", 3).alias("level"), r("level_var", 2).alias("level_var"))




@query(f"with {DAILY}, x as (select *, count(v) over w as c, avg(v) over w as m, stddev_samp(v) over w as s from daily window w as ({BY} rows between 155 preceding and current row)) select k, d, case when c >= 30 and s > 0 then round((v - m) / s, 6) end as z from x")
def trailing_z_156(spark, sf_dir):
    return W.z_score(daily(spark, sf_dir), ["k"], "d", "v", 156, 30).select("k", "d", r("z", 6).alias("z"))


@query(f"with {DAILY}, x as (select *, count(v) over w as c, avg(v) over w as m from daily window w as ({BY} rows between 5 preceding and 5 following)) select k, d, case when c = 11 then round(m, 5) end as trend from x")
def centred_trend(spark, sf_dir):
    return W.centred_trend(daily(spark, sf_dir), ["k"], "d", "v", 5).select("k", "d", r("trend", 5).alias("trend"))


@query(f"with {DAILY}, c as (select k, d, v - avg(v) over (partition by k) as x from daily), l as (select *, lag(x, 1) over ({BY}) as a, lag(x, 2) over ({BY}) as b from c), s as (select k, count(*) as n, sum(x * a) / sum(x * x) as r1, sum(x * b) / sum(x * x) as r2 from l group by 1) select k, n, round(r1, 6) as acf1, round(r2, 6) as acf2, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 4) as ljung_box from s")
def autocorrelation(spark, sf_dir):
    a = W.autocorrelation(daily(spark, sf_dir), ["k"], "d", "v", 2)
    return a.select("k", "n", r("acf1", 6).alias("acf1"), r("acf2", 6).alias("acf2"), r("ljung_box").alias("ljung_box"))


@query(f"with {DAILY}, l as (select k, ln(v) - lag(ln(v)) over ({BY}) as a, ln(v) - lag(ln(v), 5) over ({BY}) as b from daily) select k, round(var_samp(b) / (5 * var_samp(a)), 6) as variance_ratio, count(b) as n from l group by 1")
def variance_ratio(spark, sf_dir):
    d = W.variance_ratio(daily(spark, sf_dir).withColumn("lv", F.ln("v")), ["k"], "d", "lv", 5)
    return d.select("k", r("variance_ratio", 6).alias("variance_ratio"), "n")


@query(f"with {DAILY}, x as (select a.k, abs(a.v - b.v) as m from daily a join daily b on a.k = b.k and a.d = b.d + 5 where a.d <= date '1997-06-01' and a.d > date '1997-06-01' - 120) select k, case when count(m) >= 15 then round(quantile_cont(m, 0.5), 4) end as typical_move, count(m) as n from x group by 1")
def typical_move(spark, sf_dir):
    return W.typical_move(daily(spark, sf_dir), ["k"], "d", "v", 5, 120, "1997-06-01").select("k", r("typical_move").alias("typical_move"), "n")


@query(f"with {DAILY}, x as (select k, v, list(v) over ({BY} rows between 1 following and 10 following) as p from daily), f as (select k, c.x as discount, v - coalesce(list_filter(p, lambda y: y <= v * (1 - c.x))[1], p[10]) as s from x, (values (0.05::double), (0.2::double)) c(x) where len(p) = 10) select k, discount, count(s) as n, round(avg(s), 4) as mean_saving, round(avg((s > 0)::int), 6) as share_better from f group by 1, 2")
def buyer_policy(spark, sf_dir):
    from tidemark.plans.policies import buyer_policy as simulate

    p = simulate(daily(spark, sf_dir), ["k"], "d", "v", [0.05, 0.2], 10)
    return p.select("k", "discount", "n", r("mean_saving").alias("mean_saving"), r("share_better", 6).alias("share_better"))


@query(f"with {DAILY}, f as (select k, d, v + 3 * (v - lag(v, 5) over ({BY})) / 5 as f, lead(v, 3) over ({BY}) as a, v from daily) select k, count(*) as n, round(avg(abs(a - f)), 4) as drift_mae, round(avg(abs(a - v)), 4) as hold_mae from f where f is not null and a is not null group by 1")
def drift_against_hold(spark, sf_dir):
    from tidemark.plans.policies import drift_hold

    d = drift_hold(daily(spark, sf_dir), ["k"], "d", "v", 5, 3).where("forecast is not null and actual is not null")
    return d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("actual") - F.col("forecast")))).alias("drift_mae"), r(F.avg(F.abs(F.col("actual") - F.col("v")))).alias("hold_mae"))


@query(f"with {DAILY}, x as (select k, [lead(v, 1) over w, lead(v, 2) over w, lead(v, 3) over w] as a, [lag(v, 1) over w, lag(v, 2) over w, lag(v, 3) over w] as f, v * 0.8 as l, lead(v, 3) over w as z, lag(v, 3) over w as y from daily window w as ({BY})), g as (select * from x where z is not null and y is not null), h as (select k, list_min(a) <= l as hit, list_min(f) <= l as said, abs(list_position(a, list_min(a)) - list_position(f, list_min(f))) as p from g) select k, count(*) as n, round(sum((hit and said)::int) / sum(said::int), 6) as precision, round(sum((hit and said)::int) / sum(hit::int), 6) as recall, quantile_cont(p, 0.5) as timing_error from h group by 1")
def dip_precision_recall(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = daily(spark, sf_dir).select("k", F.array(*[F.lead("v", i).over(w) for i in (1, 2, 3)]).alias("a"), F.array(*[F.lag("v", i).over(w) for i in (1, 2, 3)]).alias("f"), (F.col("v") * 0.8).alias("l"))
    m = A.array_minima(d.where("a[2] is not null and f[2] is not null"), ["k"], "a", "f", "l")
    return m.select("k", "n", r("precision", 6).alias("precision"), r("recall", 6).alias("recall"), "timing_error")
