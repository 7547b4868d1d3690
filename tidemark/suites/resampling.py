"""Bootstraps over the driver's tables; the SQL draws the same blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import hac as H
from tidemark.functions import resample as B
from tidemark.sources.readers import table
from tidemark.suites import DAILY, daily, query

BY = "partition by k order by d"


def r(c, n=6):
    return F.round(c, n)


def start_sql(seed: int, most: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', k, draw, j)), 1, 12))::bigint % ({most})"


def draws_sql(name: str, source: str, block: int, draws: int, kind: str, seed: int) -> str:
    """CTE name(k, draw, draw_mean) of source(k, d, v)."""
    b = f"least({block}, n)" if kind == "circular" else str(block)
    most = "n" if kind == "circular" else f"n - {block} + 1"
    wrap = f"select * from {name}_i union all select k, v, i + n, n, b from {name}_i where i < b - 1" if kind == "circular" else f"select * from {name}_i"
    return f"""{name}_i as materialized (select *, {b} as b from (select k, v, row_number() over ({BY}) - 1 as i, count(*) over (partition by k) as n from {source} where v is not null)),
{name}_s as materialized (select k, i, list_sum(l[1:b]) as whole, list_sum(l[1:n - (ceil(n / b)::bigint - 1) * b]) as part from (select *, list(v) over (partition by k order by i rows between current row and {block - 1} following) as l from ({wrap})) where i < n),
{name}_g as materialized (select *, {start_sql(seed, most)} as i from (select k, n, ceil(n / b)::bigint as blocks, unnest(range({draws})) as draw from {name}_i where i = 0 and n >= b), lateral (select unnest(range(blocks)) as j)),
{name} as materialized (select g.k, draw, sum(case when j = blocks - 1 then part else whole end) / any_value(n) as draw_mean from {name}_g g join {name}_s s on s.k = g.k and s.i = g.i group by 1, 2)"""


SPREAD = "count(*) as n_draws, avg(draw_mean) as mean_of_draws, quantile_cont(draw_mean, 0.025) as lower, quantile_cont(draw_mean, 0.975) as upper, avg((draw_mean >= 0)::int) as up, avg((draw_mean <= 0)::int) as down"


@query(f"""with {DAILY}, {draws_sql('b', 'daily', 10, 200, 'moving', 7)}, s as (select k, {SPREAD} from b group by 1), x as (select k, count(*) as n, avg(v) as m from daily group by 1)
select k, n, round(m, 6) as mean, coalesce(n_draws, 0) as n_draws, round(lower, 6) as lower, round(upper, 6) as upper from x left join s using (k)""")
def bootstrap_interval(spark, sf_dir):
    d = B.bootstrap_mean(daily(spark, sf_dir), ["k"], "d", "v", 10, 200)
    return d.select("k", "n", "n_draws", *[r(c).alias(c) for c in ("mean", "lower", "upper")])


LOSS = f"select k, d, abs(v - lag(v) over ({BY})) / 1000 - abs(v - avg(v) over ({BY} rows between 5 preceding and 1 preceding)) / 1000 as v from daily"


@query(f"""with {DAILY}, l as ({LOSS}), {draws_sql('b', 'l', 5, 300, 'moving', 42)}, s as (select k, {SPREAD} from b group by 1), x as (select k, count(v) as n, avg(v) as m from l where v is not null group by 1)
select k, n, round(m, 6) as observed_mean_diff, n_draws, round(mean_of_draws, 6) as mean_of_draws, round(up, 6) as p_one_sided, round(lower, 6) as lower, round(upper, 6) as upper from x left join s using (k)""")
def bootstrap_loss_confirm(spark, sf_dir):
    """Holding the last value against the mean of the last five: is holding better beyond chance."""
    w = Window.partitionBy("k").orderBy("d")
    x = daily(spark, sf_dir).withColumn("loss", F.abs(F.col("v") - F.lag("v").over(w)) / 1000 - F.abs(F.col("v") - F.avg("v").over(w.rowsBetween(-5, -1))) / 1000)
    d = B.bootstrap_mean(x, ["k"], "d", "loss", 5, 300, seed=42)
    return d.select("k", "n", r("mean").alias("observed_mean_diff"), "n_draws", r("mean_of_draws").alias("mean_of_draws"), r("share_not_below_zero").alias("p_one_sided"), r("lower").alias("lower"), r("upper").alias("upper"))


MOVES = f"select k, d, abs(ln(v / lag(v) over ({BY}))) * 100 as v, n > 2 as e from daily"


@query(f"""with {DAILY}, m as (select * from ({MOVES}) where v is not null), ma as (select * from m where e), mb as (select * from m where not e), {draws_sql('a', 'ma', 1, 200, 'circular', 7)}, {draws_sql('b', 'mb', 5, 200, 'circular', 8)},
f as (select a.k, a.draw_mean - b.draw_mean as draw_mean from a join b on a.k = b.k and a.draw = b.draw), s as (select k, {SPREAD} from f group by 1),
x as (select k, count(case when e then 1 end) as n_event, count(case when not e then 1 end) as n_normal, avg(case when e then v end) as me, avg(case when not e then v end) as mn from m group by 1)
select k, n_event, n_normal, round(me, 6) as mean_event, round(mn, 6) as mean_normal, round(me - mn, 6) as observed_diff, round(case when mn > 0 then me / mn end, 6) as ratio_of_means, round(lower, 6) as lower, round(upper, 6) as upper, round(down, 6) as p_one_sided from x left join s using (k)""")
def event_move_bootstrap(spark, sf_dir):
    """Are moves larger on days with more than two orders."""
    w = Window.partitionBy("k").orderBy("d")
    x = daily(spark, sf_dir).withColumn("move", F.abs(F.ln(F.col("v") / F.lag("v").over(w))) * 100)
    d = B.difference_of_means(x, ["k"], "d", "move", F.col("n") > 2, 5, 200)
    return d.select("k", "n_event", "n_normal", *[r(c).alias(c) for c in ("mean_event", "mean_normal", "observed_diff", "ratio_of_means", "lower", "upper", "p_one_sided")])


@query(f"""with c as (select o_orderpriority as k, o_custkey, sum(o_totalprice / 1000) as s, count(*) as size from orders group by 1, 2), i as materialized (select *, row_number() over (partition by k order by o_custkey) - 1 as i from c),
g as materialized (select *, {start_sql(11, 'm')} as i from (select k, count(*) as m, unnest(range(100)) as draw from i group by k), lateral (select unnest(range(m)) as j)),
b as (select g.k, draw, sum(s) / sum(size) as draw_mean from g join i on i.k = g.k and i.i = g.i group by 1, 2), s as (select k, {SPREAD} from b group by 1)
select k, n_draws, round(mean_of_draws, 6) as mean_of_draws, round(lower, 6) as lower, round(upper, 6) as upper from s""")
def customer_cluster_bootstrap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), "o_custkey", (F.col("o_totalprice") / 1000).alias("v"))
    d = B.spread(B.cluster_draws(o, ["k"], "o_custkey", "v", 100, 11), ["k"])
    return d.select("k", "n_draws", *[r(c).alias(c) for c in ("mean_of_draws", "lower", "upper")])


LAGGED = " + ".join(f"2 * {1 - j / 6!r} * e * coalesce(lag(e, {j}) over ({BY}), 0)" for j in range(1, 6))


@query(f"""with {DAILY}, x as (select k, d, ln(v) - lag(ln(v)) over ({BY}) as x from daily), e as (select *, x - avg(x) over (partition by k) as e from x where x is not null), p as (select *, e * e + {LAGGED} as p from e),
g as (select k, count(*) as n, avg(x) as m, greatest(sum(p) / count(*), 1e-12) as v, avg(e * e) as g from p group by 1)
select k, n, round(m, 8) as mean, round(sqrt(v / n), 8) as hac_se, round(m - 1.959963984540054 * sqrt(v / n), 8) as lower, round(m + 1.959963984540054 * sqrt(v / n), 8) as upper, round(n * g / v, 4) as effective_n from g""")
def mean_return_hac(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = H.hac_mean(daily(spark, sf_dir).withColumn("x", F.ln("v") - F.lag(F.ln("v")).over(w)), ["k"], "d", "x", 5)
    return d.select("k", "n", *[r(c, 8).alias(c) for c in ("mean", "hac_se", "lower", "upper")], r("effective_n", 4).alias("effective_n"))


def score_sql(a: str, b: str) -> str:
    return f"{a} * {b} + " + " + ".join(f"{1 - j / 4!r} * ({a} * coalesce(lag({b}, {j}) over ({BY}), 0) + coalesce(lag({a}, {j}) over ({BY}), 0) * {b})" for j in range(1, 4))


@query(f"""with {DAILY}, z as (select k, d, ln(v) - lag(ln(v)) over ({BY}) as y, (extract(isodow from d) >= 6)::int::double as p, n::double as q from daily), c as (select *, p - avg(p) over (partition by k) as a, q - avg(q) over (partition by k) as b, y - avg(y) over (partition by k) as u from z where y is not null),
s as (select k, count(*) as m, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * u) as au, sum(b * u) as bu from c group by 1),
f as (select *, (bb * au - ab * bu) / (aa * bb - ab * ab) as ba, (aa * bu - ab * au) / (aa * bb - ab * ab) as bq from s), e as (select c.k, d, a * (u - ba * a - bq * b) as ga, b * (u - ba * a - bq * b) as gb from c join f using (k)),
t as (select k, {score_sql('ga', 'ga')} as saa, {score_sql('ga', 'gb')} as sab, {score_sql('gb', 'gb')} as sbb from e), o as (select k, sum(saa) as x, sum(sab) as y, sum(sbb) as z from t group by 1),
i as (select *, bb / (aa * bb - ab * ab) as iaa, -ab / (aa * bb - ab * ab) as iab, aa / (aa * bb - ab * ab) as ibb from f join o using (k)),
v as (select *, (iaa * (x * iaa + y * iab) + iab * (y * iaa + z * iab)) * m / (m - 3.0) as caa, (iaa * (x * iab + y * ibb) + iab * (y * iab + z * ibb)) * m / (m - 3.0) as cab, (iab * (x * iab + y * ibb) + ibb * (y * iab + z * ibb)) * m / (m - 3.0) as cbb from i),
w as (select *, (cbb * ba * ba - 2 * cab * ba * bq + caa * bq * bq) / (caa * cbb - cab * cab) as wald from v)
select k, m as n, round(ba, 6) as weekend, round(bq, 6) as orders, round(sqrt(caa), 6) as se_weekend, round(sqrt(cbb), 6) as se_orders, round(wald, 5) as wald, round(exp(-wald / 2), 6) as p_value from w""")
def weekend_wald_test(spark, sf_dir):
    """Do the weekend and the number of orders move a day's return: both coefficients zero, errors over three lags."""
    w = Window.partitionBy("k").orderBy("d")
    z = daily(spark, sf_dir).select("k", "d", (F.ln("v") - F.lag(F.ln("v")).over(w)).alias("y"), (F.weekday("d") >= 5).cast("double").alias("p"), F.col("n").cast("double").alias("q"))
    d = H.hac_regression(z, ["k"], "d", ["p", "q"], "y", 3)
    return d.select("k", "n", r(F.col("beta")[1]).alias("weekend"), r(F.col("beta")[2]).alias("orders"), r(F.col("se")[1]).alias("se_weekend"), r(F.col("se")[2]).alias("se_orders"), r("wald", 5).alias("wald"), r("p_value").alias("p_value"))
