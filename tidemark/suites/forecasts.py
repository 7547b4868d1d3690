"""Interval baselines, size-bucketed ranges, trends, decompositions and evaluations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import ranges as R
from tidemark.suites import DAILY, daily, query

BY = "partition by k order by d"


def by_day():
    return Window.partitionBy("k").orderBy("d")


def r(c, n=6):
    return F.round(c, n)


def rounded(df, keep, columns):
    return df.select(*keep, *[r(F.col(c)).alias(c) for c in columns])


@query(f"""with {DAILY}, a as (select k, d, ln(v) - lag(ln(v)) over ({BY}) as x from daily), b as (select *, row_number() over ({BY}) - 1 as i from a where x is not null),
s as (select k, var_samp(x) as s from b where i < 30 group by 1)
select k, d, round(pow(0.94, i + 1) * s + 0.06 * pow(0.94, i) * sum(x * x * pow(0.94, -i)) over ({BY}), 6) as variance from b join s using (k)""")
def ewma_variance_path(spark, sf_dir):
    x = daily(spark, sf_dir).withColumn("x", F.log("v") - F.lag(F.log("v")).over(by_day()))
    return rounded(R.ewma_variance(x, ["k"], "d", "x"), ["k", "d"], ["variance"])


@query(f"""with {DAILY}, a as (select k, d, ln(v) as p, ln(v) - lag(ln(v)) over ({BY}) as x, ln(v) - lag(ln(v), 5) over ({BY}) as h, lead(ln(v), 5) over ({BY}) - ln(v) as actual from daily),
b as (select *, case when count(x) over ({BY} rows between 249 preceding and current row) = 250 then stddev_samp(x) over ({BY} rows between 249 preceding and current row) * sqrt(5) end as hv,
case when count(h) over w >= 60 then quantile_cont(h, 0.1) over w end as hs_low, case when count(h) over w >= 60 then quantile_cont(h, 0.9) over w end as hs_high from a window w as ({BY} rows between 499 preceding and current row)),
c as (select *, row_number() over ({BY}) - 1 as i from b where x is not null), s as (select k, var_samp(x) as s from c where i < 30 group by 1),
e as (select *, case when i >= 29 then sqrt(5 * (pow(0.94, i + 1) * s + 0.06 * pow(0.94, i) * sum(x * x * pow(0.94, -i)) over ({BY}))) end as ew from c join s using (k))
select k, d, round(actual, 6) as actual, round(-1.2815515655446004 * hv, 6) as hv_low, round(1.2815515655446004 * hv, 6) as hv_high, round(hs_low, 6) as hs_low, round(hs_high, 6) as hs_high, round(-1.2815515655446004 * ew, 6) as ew_low, round(1.2815515655446004 * ew, 6) as ew_high from e where actual is not null""")
def interval_baselines(spark, sf_dir):
    return rounded(R.interval_sets(daily(spark, sf_dir), ["k"], "d", "v", 5), ["k", "d"], ["actual", "hv_low", "hv_high", "hs_low", "hs_high", "ew_low", "ew_high"])


@query(f"""with {DAILY}, a as (select k, d, v, lag(v) over ({BY}) as v0, ln(v) - lag(ln(v)) over ({BY}) as x from daily),
b as (select *, avg(x) over w as f, stddev_samp(x) over w as vol, count(x) over w as m from a window w as ({BY} rows between 10 preceding and 1 preceding)),
c as (select k, d, case when vol > 0 then round(abs(f) / vol, 8) end as z, case when vol > 0 then round(abs(v - v0 * exp(f)) / (vol * v0), 8) end as s, row_number() over ({BY}) as i from b where m = 10),
g as (select *, count(*) over w as n, quantile_cont(z, 0.5) over w as mid, quantile_cont(s, 0.8) over w as pooled from c window w as ({BY} rows between 60 preceding and 1 preceding)),
o as (select g.k, g.i, count(*) as own, quantile_cont(p.s, 0.8) as q from g join c p on p.k = g.k and p.i between g.i - 60 and g.i - 1 and p.z is not null and (p.z > g.mid) = (g.z > g.mid) group by 1, 2)
select k, d, round(case when n >= 20 then pooled end, 6) as q_pooled, case when n >= 20 then case when z is null then 'pooled_no_size' else case when z > mid then 'high' else 'low' end || case when coalesce(own, 0) < 15 then '_pooled' else '' end end end as bucket,
round(case when n >= 20 then case when z is null or coalesce(own, 0) < 15 then pooled else q end end, 6) as q_bucket from g left join o using (k, i)""")
def size_bucketed_range(spark, sf_dir):
    past = by_day().rowsBetween(-10, -1)
    x = daily(spark, sf_dir).withColumn("v0", F.lag("v").over(by_day())).withColumn("x", F.log("v") - F.log("v0"))
    x = x.withColumns({"f": F.avg("x").over(past), "vol": F.stddev_samp("x").over(past), "m": F.count("x").over(past)}).where("m = 10")
    z = F.when(F.col("vol") > 0, r(F.abs("f") / F.col("vol"), 8))
    s = F.when(F.col("vol") > 0, r(F.abs(F.col("v") - F.col("v0") * F.exp("f")) / (F.col("vol") * F.col("v0")), 8))
    return rounded(R.size_bucketed(x.select("k", "d", z.alias("z"), s.alias("s")), ["k"], "d", "z", "s"), ["k", "d", "bucket"], ["q_pooled", "q_bucket"])


@query(f"""with {DAILY}, p as (select k, v, row_number() over ({BY}) - 1 as x, count(*) over (partition by k) as n_days from (select *, max(d) over (partition by k) as e from daily) where d >= e - interval 30 day),
s as (select a.k, quantile_cont((b.v - a.v) / (b.x - a.x), 0.5) as slope from p a join p b on a.k = b.k and a.x < b.x group by 1),
e as (select p.k, x, n_days, slope, v - slope * x as e from p join s using (k)), c as (select k, quantile_cont(e, 0.5) as c from e group by 1), m as (select k, 1.4826 * quantile_cont(abs(e - c), 0.5) as s from e join c using (k) group by 1)
select k, n_days, round(slope, 6) as slope, round(e - c, 6) as residual, round(case when s > 0 then (e - c) / s else 0 end, 6) as residual_z, case when slope <= -5 then 'falling' when slope >= 5 then 'rising' else 'flat' end as state
from e join c using (k) join m using (k) where x = n_days - 1 and n_days >= 10""")
def trend_residual_30d(spark, sf_dir):
    return rounded(R.trend_residual(daily(spark, sf_dir), ["k"], "d", "v"), ["k", "n_days", "state"], ["slope", "residual", "residual_z"])


@query(f"""with {DAILY}, w as (select *, 40 + extract(day from d) as m from (select *, max(d) over (partition by k) as e from daily) where d >= e - interval 90 day),
c as (select k, count(*) as n_obs, arg_max(ln(v), d) - arg_min(ln(v), d) as cv, arg_max(ln(n), d) - arg_min(ln(n), d) as cn, arg_max(ln(m), d) - arg_min(ln(m), d) as cm from w group by 1)
select k, n_obs, round(cv, 6) as change_v, round(cn, 6) as change_n, round(cm, 6) as change_m, round(cv - cn - cm, 6) as change_rest, round(case when abs(cv) < 1e-8 then 0 else abs((cv - cn - cm) / cv) * 100 end, 6) as rest_share, abs(cv) >= 1e-8 and abs((cv - cn - cm) / cv) * 100 <= 15 as valid from c""")
def log_decomposition(spark, sf_dir):
    x = daily(spark, sf_dir).withColumn("m", 40 + F.dayofmonth("d"))
    return rounded(R.log_shares(x, ["k"], "d", "v", ["n", "m"], 90), ["k", "n_obs", "valid"], ["change_v", "change_n", "change_m", "change_rest", "rest_share"])


@query(f"""with {DAILY}, a as (select k, d, lead(d, 5) over ({BY}) as known, lead(v, 5) over ({BY}) > v as y, case when v > lag(v) over ({BY}) then 1.0 else 0.0 end as up from daily),
b as (select *, avg(up) over ({BY} rows between 19 preceding and current row) as p from a),
f as (select b.k, b.d, b.p, b.y::int as y, count(*) as n, avg(q.y::int) as base from b join b q on q.k = b.k and q.known + interval 5 day < b.d where b.y is not null group by 1, 2, 3, 4 having count(*) >= 30)
select k, count(*) as n_folds, round(avg((p - y) ** 2), 6) as brier, round(avg((base - y) ** 2), 6) as base_brier, round(avg(((p >= 0.5) = (y = 1))::int), 6) as accuracy, round(avg(((base >= 0.5) = (y = 1))::int), 6) as base_accuracy, round(1 - avg((p - y) ** 2) / avg((base - y) ** 2), 6) as skill from f group by 1""")
def embargoed_walk_forward(spark, sf_dir):
    up = F.coalesce((F.col("v") > F.lag("v").over(by_day())).cast("double"), F.lit(0.0))
    x = daily(spark, sf_dir).select("k", "d", F.lead("d", 5).over(by_day()).alias("known"), (F.lead("v", 5).over(by_day()) > F.col("v")).alias("y"), up.alias("up")).withColumn("p", F.avg("up").over(by_day().rowsBetween(-19, 0)))
    return rounded(R.embargoed_evaluation(x, ["k"], "d", "known", "p", "y"), ["k", "n_folds"], ["brier", "base_brier", "accuracy", "base_accuracy", "skill"])


CELLS = [(z, h) for h in (1, 5) for z in (0.5, 1.0, 1.5)]


def cell_sql() -> str:
    lagged = lambda h: " + ".join(f"{2 * (1 - j / (h + 1))!r} * g * coalesce(lag(g, {j}) over w, 0)" for j in range(1, h + 1))
    cells = " union all ".join(f"select k, d, {z} as z_threshold, {h} as horizon, (z >= {z})::int as x, y{h} as y from a where z is not null and y{h} is not null" for z, h in CELLS)
    return f"""with {DAILY}, a as (select k, d, (v - avg(v) over u) / stddev_samp(v) over u as z, lead(ln(v), 1) over ({BY}) - ln(v) as y1, lead(ln(v), 5) over ({BY}) - ln(v) as y5 from daily window u as ({BY} rows between 19 preceding and current row)), c as ({cells}),
s as (select k, z_threshold, horizon, count(*) as n, sum(x) as k1, regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(x) as mx, n * sum(x * x) - sum(x) * sum(x) as det from c group by 1, 2, 3),
e as (select *, y - a - b * x as u, n * (x - mx) / det * (y - a - b * x) as g from c join s using (k, z_threshold, horizon)),
t as (select *, g * g + case when horizon = 1 then {lagged(1)} else {lagged(5)} end as v from e window w as (partition by k, z_threshold, horizon order by d)),
o as (select k, z_threshold, horizon, n, k1, a, b, sqrt(greatest(sum(v) * n / (n - 2), 0)) as se_b, sqrt(sum(u * u) / (n - 2) * n / any_value(det)) as se_plain from t group by 1, 2, 3, 4, 5, 6, 7)
select k, z_threshold::double as z_threshold, horizon, n, round(a, 6) as a, round(b, 6) as b, round(se_b, 6) as se_b, round(se_plain, 6) as se_plain, round(b / se_b, 4) as t, round(k1 * (se_plain / se_b) ** 2, 4) as effective_n from o"""


@query(cell_sql())
def signal_cells(spark, sf_dir):
    u = by_day().rowsBetween(-19, 0)
    sd = F.stddev_samp("v").over(u)
    x = daily(spark, sf_dir).withColumn("z", F.when(sd > 0, (F.col("v") - F.avg("v").over(u)) / sd))
    x = x.withColumns({f"y{h}": F.lead(F.log("v"), h).over(by_day()) - F.log("v") for h in (1, 5)})
    out = None
    for h in (1, 5):
        cells = x.withColumn("z_threshold", F.explode(F.array(*[F.lit(z) for z, g in CELLS if g == h]))).withColumn("horizon", F.lit(h))
        got = R.hac_slope(cells.withColumn("x", (F.col("z") >= F.col("z_threshold")).cast("double")), ["k", "z_threshold", "horizon"], "d", "x", f"y{h}", h)
        out = got if out is None else out.unionByName(got)
    return out.select("k", "z_threshold", "horizon", "n", *[r(F.col(c), n).alias(c) for c, n in (("a", 6), ("b", 6), ("se_b", 6), ("se_plain", 6), ("t", 4), ("effective_n", 4))])


@query(f"""with {DAILY}, p as (select *, row_number() over ({BY}) as i from daily), t as (select * from p where d = date '1997-06-02'),
j as (select t.k, t.v, t.i - 1 as n_history, count(p.v) as m, count(case when p.v <= t.v then 1 end) as le, quantile_cont(p.v, 0.25) as a, quantile_cont(p.v, 0.75) as b from t left join p on p.k = t.k and p.i between t.i - 90 and t.i - 1 group by 1, 2, 3)
select k, v, n_history, case when m > 0 then round(100.0 * le / m, 6) end as percentile, case when m >= 10 then case when v < a then 'lower' when v > b then 'higher' else 'usual' end end as category from j""")
def markup_today(spark, sf_dir):
    x = R.position_today(daily(spark, sf_dir), ["k"], "d", "v", "1997-06-02")
    return x.select("k", "v", "n_history", r(F.col("percentile")).alias("percentile"), "category")


@query(f"""with {DAILY}, w as (select *, arg_max(v, d) over (partition by k) as now from (select *, max(d) over (partition by k) as e from daily) where d >= e - interval 90 day)
select k, count(*) as n_days, any_value(now) as current, min(v) as low, floor(avg((v <= now)::int) * 100 + 0.5)::bigint as percentile, round((any_value(now) - min(v)) / min(v) * 100, 6) as distance_pct, (any_value(now) - min(v)) / min(v) * 100 <= 2 as near_support from w group by 1 having count(*) >= 60""")
def band_position_90d(spark, sf_dir):
    x = R.band_position(daily(spark, sf_dir), ["k"], "d", "v")
    return x.select("k", "n_days", "current", "low", "percentile", r(F.col("distance_pct")).alias("distance_pct"), "near_support")


@query()
def boosted_range(spark, sf_dir):
    """Quantiles of the log return over five rows by boosted trees, walk-forward in three folds (no SQL: iterative; tests hold the trees against a plain version)."""
    from tidemark.plans import boosting

    w = Window.partitionBy("k").orderBy("d")
    x = F.ln("v")
    d = daily(spark, sf_dir).withColumns({"r1": x - F.lag(x).over(w), "actual": F.lead(x, 5).over(w) - x, "known": F.lead("d", 5).over(w)})
    d = d.withColumns({"vol5": F.stddev_samp("r1").over(w.rowsBetween(-4, 0)), "vol20": F.stddev_samp("r1").over(w.rowsBetween(-19, 0)), "away": x - F.avg(x).over(w.rowsBetween(-19, 0))})
    parts = boosting.folds(d, "d", "known", ["1998-01-01", "1999-07-01", "2001-01-01"])
    out = boosting.quantiles(parts, ["fold"], ["r1", "vol5", "vol20", "away"], "actual", (0.1, 0.9), rounds=5, rate=0.2)
    return out.select("k", "d", "fold", "level", F.round("actual", 6).alias("actual"), F.round("estimate", 6).alias("estimate"))
