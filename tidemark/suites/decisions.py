"""Alert delivery, champion and challengers, evaluation of fitted models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import evaluation as E
from tidemark.plans import promotion as P
from tidemark.sources.readers import table
from tidemark.streaming import delivery as D
from tidemark.streaming import late as L
from tidemark.suites import DAILY, daily, query

BY = "partition by k order by d"
HOUR, DAY, SHIFT = 3_600_000_000, 86_400_000_000, 19_800_000_000
ALERTS = D.Rules({"error": D.Policy("cooldown", 24, public=True), "purchase": D.Policy("cooldown", 12, public=True), "view": D.Policy("daily"), "signup": D.Policy("once"), "click": D.Policy("daily", bypass=True)})


def r(c, n=6):
    return F.round(c, n)


def by_day():
    return Window.partitionBy("k").orderBy("d")


@query(f"""with recursive a as (select distinct user_id as k, event_type as g, epoch_us(ts) as u from events), q as (select *, u + {SHIFT} as loc, (u + {SHIFT}) % {DAY} // {HOUR} as h, u + {SHIFT} - (u + {SHIFT}) % {DAY} as s from a),
d as (select k, g, u as raised, case when g <> 'click' and (h >= 22 or h < 7) then case when s + 7 * {HOUR} > loc then s + 7 * {HOUR} else s + 31 * {HOUR} end - {SHIFT} end as rel from q),
c as (select k, g, raised, raised as due from d where rel is null union all select k, g, max(raised), rel from d where rel is not null group by k, g, rel having rel - max(raised) <= 12 * {HOUR}),
st as (select *, row_number() over (partition by k, g, case when g = 'signup' then 0 else (due + {SHIFT}) // {DAY} end order by due, raised) as r from c where g in ('view', 'click', 'signup')),
e as (select *, row_number() over (partition by k order by due, raised, g) as i from c where g in ('error', 'purchase')),
w(k, i, le, lp, rec, g, raised, due, ok) as (select distinct k, 0::bigint, null::bigint, null::bigint, []::bigint[], null::varchar, null::bigint, null::bigint, false from e
union all select k, i, case when ok and g = 'error' then due else le end, case when ok and g = 'purchase' then due else lp end, case when ok then list_append(now, due) else now end, g, raised, due, ok from (
select e.k, e.i, e.g, e.raised, e.due, w.le, w.lp, list_filter(w.rec, lambda x: x > e.due - {DAY}) as now, len(list_filter(w.rec, lambda x: x > e.due - {DAY})) < 3 and (case when e.g = 'error' then w.le is null or w.le <= e.due - 24 * {HOUR} else w.lp is null or w.lp <= e.due - 12 * {HOUR} end) as ok from w join e on e.k = w.k and e.i = w.i + 1)),
f as (select k, g, raised, due from st where r = 1 union all select k, g, raised, due from w where ok)
select k as user_id, g as trigger, make_timestamp(raised) as raised_at, make_timestamp(due) as sent_at, case when g in ('error', 'purchase') then 'public' else 'operations' end as sink from f""")
def delivered_alerts(spark, sf_dir):
    d = D.delivered(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ALERTS)
    return d.select("user_id", "trigger", F.col("raised_at").cast("timestamp_ntz").alias("raised_at"), F.col("sent_at").cast("timestamp_ntz").alias("sent_at"), "sink")


#: Distance s(n) of the bound at level 0.05 / 3 with mix_sd 0.3, by Newton's steps; n from the table given.
STAR = """nn as (select distinct n::double as n from {src} where n >= 20), nt(n, a, t, s, j) as (select n, n + 1 / 0.09, ln(60.0) - ln(2 / 0.3) + ln(n + 1 / 0.09) / 2, sqrt(2 * (n + 1 / 0.09) * (ln(60.0) - ln(2 / 0.3) + ln(n + 1 / 0.09) / 2 + ln(2.0))), 0 from nn
union all select n, a, t, s - (s * s / (2 * a) + ln(0.5 + den * ser) - t) / (s / a + den / (sqrt(a) * (0.5 + den * ser))), j + 1 from (select *, exp(-s * s / (2 * a)) / sqrt(2 * pi()) as den, list_sum(list_transform(range(0, 111), lambda q: exp((2 * q + 1) * ln(s / sqrt(a)) - lgamma(2 * q + 2) + q * ln(2.0) + lgamma(q + 1)))) as ser from nt where j < 30)),
star as (select n, s from nt where j = 30)"""
LONG_RUN = "(list_inner_product(c, c) + 2 * (" + " + ".join(f"case when n > {g} then {1 - g / 5} * list_inner_product(c[{g + 1}:], c[1:n - {g}]) else 0 end" for g in range(1, 5)) + ")) / n"


@query(f"""with recursive {DAILY}, x as (select k, d, (0.95 * abs(v - 200000) - abs(v - 230000)) / 997 as e from daily), l as (select k, d, row_number() over w as n, list(e) over w as l from x window w as ({BY})),
c as (select k, d, n, list_avg(l) as m, list_transform(l, lambda z: z - list_avg(l)) as c from l where n >= 2), v as (select k, d, n, m, greatest({LONG_RUN}, list_inner_product(c, c) / n, 0) * 1.5 as v from c), {STAR.format(src='v')}
select k, d, n, round(m, 6) as mean, round(case when v > 0 then m - sqrt(v) * s / n end, 6) as lower from (select k, d, n, m, v from v union all select k, d, n, l[1], null from l where n = 1) left join star using (n)""")
def anytime_bounds(spark, sf_dir):
    v = F.col("v")
    x = daily(spark, sf_dir).withColumn("e", (0.95 * F.abs(v - 200000) - F.abs(v - 230000)) / 997)
    d = P.anytime_lower(x, ["k"], "d", "e", 0.05 / 3, 4, 0.3, 20, 1.5)
    return d.select("k", "d", F.col("n").cast("long").alias("n"), r("mean").alias("mean"), r("lower").alias("lower"))


FORECASTS = {"median40": "m40", "blend": "(v + m40) / 2", "hold": "v"}
KEYS = "k, name"


@query(f"""with recursive {DAILY}, a as (select k, d, v, lead(v) over ({BY}) as v1, avg(v) over ({BY} rows between 4 preceding and current row) as m5, avg(v) over ({BY} rows between 39 preceding and current row) as m40, n as o, row_number() over ({BY}) as i from daily),
b as ({' union all '.join(f"select k, d, v, v1, m5, i, o, '{c}' as name, {f} as f from a" for c, f in FORECASTS.items())}),
x as (select k, d, name, abs(v1 - m5) as la, case when i >= 40 and not (name = 'blend' and o > 2) then abs(v1 - f) end as lb, case when v1 <> v and m5 <> v then ((m5 > v) = (v1 > v))::int end as ha, case when v1 <> v and f <> v then ((f > v) = (v1 > v))::int end as hb, (abs(v1 - f) <= 0.45 * f)::int as cov from b where v1 is not null),
z as (select *, la is not null and lb is not null as both_ from x), sp as (select *, min(case when both_ then d end) over (partition by {KEYS}) as fd, max(case when both_ then d end) over (partition by {KEYS}) as ldd from z),
g as (select {KEYS}, count(*) filter (both_) as n, any_value(fd) as first_day, any_value(ldd) as last_day, avg(la) filter (both_) as mc, avg(lb) filter (both_) as mb, count(cov) filter (both_) as cn, coalesce(sum(cov) filter (both_), 0) as ck, avg(ha) filter (both_ and ha is not null and hb is not null) as da, avg(hb) filter (both_ and ha is not null and hb is not null) as db, count(*) filter (d > fd and d <= ldd) as since from sp group by {KEYS}),
l as (select {KEYS}, count(*) as n, list(0.95 * la - lb order by d) as l from z where both_ group by {KEYS}), c as (select {KEYS}, n, list_avg(l) as m, list_transform(l, lambda q: q - list_avg(l)) as c from l),
v as (select {KEYS}, n, m, greatest({LONG_RUN}, list_inner_product(c, c) / n, 0) * 1.5 as v from c), {STAR.format(src='v')},
lo as (select {KEYS}, case when v > 0 then m - sqrt(v) * s / v.n end as lower from v left join star on v.n = star.n),
o as (select g.*, lower, n >= 20 and lower is not null as looks, case when cn > 0 then list_sum(list_transform(range(0, ck::bigint + 1), lambda j: exp(lgamma(cn + 1) - lgamma(j + 1) - lgamma(cn - j + 1) + j * ln(0.8) + (cn - j) * ln(0.2)))) end as cp from g left join lo using (k, name)),
pr as (select *, name <> 'hold' and since < 180 and looks and lower > 0 and coalesce(cp >= 0.05, false) and coalesce(db >= da, false) as ok from o)
select k, name, n, first_day, last_day, round(mc, 4) as mae_champion, round(mb, 4) as mae_challenger, round(case when n >= 2 then case when mc > 0 then 1 - mb / mc else 0 end end, 6) as gain, round(case when looks then 0.05 + lower / mc end, 6) as lower_bound, coalesce(looks and lower > 0, false) as clears, cn as coverage_n, round(case when cp is not null then least(cp, 1.0) end, 6) as coverage_p_below, round(da, 6) as direction_champion, round(db, 6) as direction_challenger, since as days_since_registration, greatest(180 - since, 0) as horizon_left, since >= 180 as retired, coalesce(ok, false) as promotable, coalesce(name = first_value(case when ok then name end) over (partition by k order by coalesce(ok, false) desc, mb, name), false) as promoted from pr""")
def challenger_comparison(spark, sf_dir):
    past = lambda n: F.avg("v").over(by_day().rowsBetween(1 - n, 0))
    a = daily(spark, sf_dir).withColumns({"v1": F.lead("v").over(by_day()), "m5": past(5), "m40": past(40), "i": F.row_number().over(by_day())}).where("v1 is not null")
    a = a.withColumn("x", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.expr(f).alias("f")) for c, f in FORECASTS.items()]))).select("*", "x.*")
    right = lambda f: F.when((F.col("v1") != F.col("v")) & (F.col(f) != F.col("v")), ((F.col(f) > F.col("v")) == (F.col("v1") > F.col("v"))).cast("int"))
    issued = (F.col("i") >= 40) & ~((F.col("name") == "blend") & (F.col("n") > 2))
    miss = F.abs(F.col("v1") - F.col("f"))
    x = a.select("k", "d", "name", F.abs(F.col("v1") - F.col("m5")).alias("la"), F.when(issued, miss).alias("lb"), right("m5").alias("ha"), right("f").alias("hb"), (miss <= 0.45 * F.col("f")).alias("cov"))
    c = P.promoted(P.compared(x, ["k"], "name", "d", loss_a="la", loss_b="lb", hit_a="ha", hit_b="hb", covered="cov"), ["k"], "name", ["median40", "blend"])
    return c.select("k", "name", "n", "first_day", "last_day", r("mae_champion", 4).alias("mae_champion"), r("mae_challenger", 4).alias("mae_challenger"), r("gain").alias("gain"), r("lower_bound").alias("lower_bound"), F.col("lower_bound_clears").alias("clears"), "coverage_n", r("coverage_p_below").alias("coverage_p_below"), r("direction_champion").alias("direction_champion"), r("direction_challenger").alias("direction_challenger"), "days_since_registration", "horizon_left", "retired", "promotable", "promoted")


FEATURES = ["f1", "f2", "f3"]
_SIDES = [(i, c, w) for i in range(1, 4) for c, w in ((0, "(1 - b.y)"), (1, "b.y"))]
_LOGIT = " + ".join(f"coalesce(case when m{i}0 > 0 and m{i}1 > 0 then case when v{i} > 1e-12 then ((f{i} - s{i}0 / m{i}0) ** 2 - (f{i} - s{i}1 / m{i}1) ** 2) / (2 * v{i}) end end, 0)" for i in range(1, 4))
FOLDS = f"""{DAILY}, a as (select k, d, v, ln(v / lag(v) over ({BY})) as f1, n::double as f2, case when n > 1 then ln(v / lag(v, 5) over ({BY})) end as f3, lead(v, 2) over ({BY}) as v2, lead(d, 2) over ({BY}) as ld from daily),
x as (select *, (v2 > v)::int::double as y, row_number() over ({BY}) as i from a where v2 is not null),
s as (select a.k, a.d, count(b.y) as n, coalesce(sum(b.y), 0) as n1, arg_max(b.y, b.d) as prev, {', '.join(f"coalesce(sum({w}) filter (b.f{i} is not null), 0) as m{i}{c}, coalesce(sum({w} * b.f{i}), 0) as s{i}{c}, coalesce(sum({w} * b.f{i} * b.f{i}), 0) as q{i}{c}" for i, c, w in _SIDES)} from x a left join x b on a.k = b.k and b.ld < a.d where a.i > 30 group by 1, 2),
t as (select x.k, x.d, x.y, f1, f2, f3, s.* exclude (k, d), s.n >= 30 and n1 > 0 and n1 < s.n as ok, {', '.join(f"case when m{i}0 > 0 and m{i}1 > 0 then (q{i}0 - s{i}0 * s{i}0 / m{i}0 + q{i}1 - s{i}1 * s{i}1 / m{i}1) / (m{i}0 + m{i}1) end as v{i}" for i in range(1, 4))} from x join s on x.k = s.k and x.d = s.d),
p as (select k, d, y, n, case when ok then round(1 / (1 + exp(-(ln(case when ok then n1 / (n - n1) end) + {_LOGIT}))), 9) end as p, case when ok then prev end as persistence from t)"""


def folds(spark, sf_dir):
    w = by_day()
    a = daily(spark, sf_dir).withColumns({"f1": F.ln(F.col("v") / F.lag("v").over(w)), "f2": F.col("n").cast("double"), "f3": F.when(F.col("n") > 1, F.ln(F.col("v") / F.lag("v", 5).over(w))), "v2": F.lead("v", 2).over(w), "ld": F.lead("d", 2).over(w)})
    a = a.withColumn("y", F.when(F.col("v2").isNotNull(), (F.col("v2") > F.col("v")).cast("int")))
    return E.fold_predictions(a, ["k"], "d", "ld", FEATURES, "y").withColumn("p", r("p", 9))


@query(f"with {FOLDS} select k, d, n::bigint as n_train, round(p, 6) as p, persistence from p")
def embargoed_predictions(spark, sf_dir):
    return folds(spark, sf_dir).select("k", "d", "n_train", r("p").alias("p"), "persistence")


_RIGHT = {c: f"(({c} >= 0.5) = (y = 1))" for c in ("p", "persistence")}
_LOSS = "avg(-case when y = 1 then ln(greatest(least({c}, 1 - 1e-15), 1e-15)) else ln(1 - greatest(least({c}, 1 - 1e-15), 1e-15)) end) filter (p is not null)"


@query(f"""with {FOLDS}, e as (select k, sum(m * gap) / sum(m) as ece from (select k, least(floor(p * 10), 9) as bin, count(*) as m, abs(avg(p) - avg(y)) as gap from p where p is not null group by 1, 2) group by 1),
g as (select k, count(p) as n_folds, count(*) - count(p) as n_skipped, avg(y) filter (p is not null) as up, avg({_RIGHT['p']}::int) filter (p is not null) as ma, avg({_RIGHT['persistence']}::int) filter (p is not null) as pa, avg((p - y) * (p - y)) filter (p is not null) as mb, avg((persistence - y) * (persistence - y)) filter (p is not null) as pb, {_LOSS.format(c='p')} as ml, {_LOSS.format(c='persistence')} as pl,
count(*) filter (p is not null and {_RIGHT['p']} and not {_RIGHT['persistence']}) as b, count(*) filter (p is not null and not {_RIGHT['p']} and {_RIGHT['persistence']}) as c from p group by 1)
select k, n_folds, n_skipped, round(up, 6) as always_up_accuracy, round(ma, 6) as model_accuracy, round(mb, 6) as model_brier, round(ml, 6) as model_log_loss, round(pa, 6) as persistence_accuracy, round(pb, 6) as persistence_brier, round(pl, 5) as persistence_log_loss, round(ece, 6) as model_ece, b + c as n_discordant,
round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda j: exp(lgamma(b + c + 1) - lgamma(j + 1) - lgamma(b + c - j + 1) + (b + c) * ln(0.5))))), 6) as p_value from g join e using (k)""")
def embargoed_scores(spark, sf_dir):
    s = E.fold_scores(folds(spark, sf_dir), ["k"], "y")
    whole = ["n_folds", "n_skipped", "n_discordant"]
    return s.select("k", *whole, *[r(c, 5 if c == "persistence_log_loss" else 6).alias(c) for c in s.columns if c not in ("k", *whole)])


@query("""with e as (select user_id, event_id, ts, cast(ts as date) as day from events), p as (select user_id, day, lag(day) over (partition by user_id order by day) as d from (select distinct user_id, day from e)),
a as (select user_id, d, ts, event_id from e join p using (user_id, day) where d is not null)
select user_id, d as decided, arg_min(event_id, (ts, event_id)) as event_id, epoch_us(min(ts)) as arrived, cast(min(ts) as date) - d > 3 as late from a group by 1, 2""")
def late_records(spark, sf_dir):
    """Each active day of a user is decided by the first event of the next one; after more than three days the record is late."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"))
    days = e.select("user_id", "day").distinct().withColumn("decided", F.lag("day").over(Window.partitionBy("user_id").orderBy("day")))
    a = e.join(days.where("decided is not null"), ["user_id", "day"]).drop("day")
    return L.first_records(a, ["user_id"], "decided", "ts").select("user_id", "decided", "event_id", F.unix_micros("ts").alias("arrived"), "late")
