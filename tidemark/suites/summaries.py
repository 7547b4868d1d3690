"""Aggregates, rules, stores, scalars, tests and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import stats as T
from tidemark.operators import aggregates as A
from tidemark.operators import quality as Q
from tidemark.plans import gates as G
from tidemark.sources import readers as R
from tidemark.sources import stores as K
from tidemark.sources.readers import table
from tidemark.streaming import alerts as ST
from tidemark.suites import DAILY, daily, query

BY = "partition by k order by d"


def r(c, n=4):
    return F.round(c, n)


@query("with g as (select l_returnflag as k, l_extendedprice as v, sum(l_quantity) as w from lineitem group by 1, 2), c as (select k, v, sum(w) over (partition by k order by v) as c, sum(w) over (partition by k) as t from g) select k, min(v) as weighted_percentile from c where c >= 0.8 * t group by 1")
def weighted_percentile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "k")
    return A.weighted_percentile(li, ["k"], "l_extendedprice", "l_quantity", 0.8)


@query("""with x as (select cast(ts as date) as d, event_type, value, case event_type when 'purchase' then 3.0 when 'click' then 2.0 else 1.0 end as w from events where value is not null), m as (select d, sum(w * value) / sum(w) as fused, count(*) as n, max(value) as hi, min(value) as lo from x group by 1)
select d, round(fused, 5) as fused, n, round(greatest(hi - fused, fused - lo) / abs(fused), 4) as max_deviation, greatest(hi - fused, fused - lo) / abs(fused) <= 0.9 as agree from m""")
def fused_benchmark(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    f = A.fuse(e, ["d"], "event_type", "value", {"purchase": 3.0, "click": 2.0}, 1.0, 0.9)
    return f.select("d", r("fused", 5).alias("fused"), "n", r("max_deviation").alias("max_deviation"), "agree")


@query("""with g as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 3.6e9 as g, ts from events)
select user_id, count(g) as n_gaps, round(quantile_cont(g, 0.5), 5) as median_gap, round(quantile_cont(g, 0.9), 5) as p90_gap, round(greatest(max(g), (epoch_us(timestamp '2024-02-01') - epoch_us(max(ts))) / 3.6e9), 5) as max_gap from g group by 1""")
def gap_distribution(spark, sf_dir):
    g = A.gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", F.lit("2024-02-01").cast("timestamp"))
    return g.select("user_id", "n_gaps", *[r(c, 5).alias(c) for c in ("median_gap", "p90_gap", "max_gap")])


@query("""with x as (select user_id, count(*) as n, sum(case when event_type <> 'error' then 1 else 0 end) as k from events group by 1), y as (select *, k / n as p, 1.96 * 1.96 as zz from x)
select user_id, n, cast(k as bigint) as k, round(p, 6) as rate, round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n))), 6) as lower, round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n))), 6) as upper from y""")
def success_rate_wilson(spark, sf_dir):
    s = A.success_rate(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error")
    return s.select("user_id", "n", "k", r("rate", 6).alias("rate"), r("lower", 6).alias("lower"), r("upper", 6).alias("upper"))


@query(f"with {DAILY}, x as (select *, min(v) over w as lo, max(v) over w as hi from daily window w as ({BY} rows between 10 preceding and 1 preceding)) select k, cast(sum(case when lo is not null then 1 else 0 end) as bigint) as n, round(avg(case when lo is not null then cast(v >= lo and v <= hi as int) end), 6) as coverage, round(avg(hi - lo), 5) as mean_width from x group by 1")
def coverage_band(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d").rowsBetween(-10, -1)
    d = daily(spark, sf_dir).withColumn("lo", F.min("v").over(w)).withColumn("hi", F.max("v").over(w))
    return A.coverage(d, ["k"], "lo", "hi", "v").select("k", "n", r("coverage", 6).alias("coverage"), r("mean_width", 5).alias("mean_width"))


SCORED = "s as (select l.doc_id, l.quality as y, l.toxic, least(1.0, d.n_chars / 5000.0) as p from labels l join documents d using (doc_id))"


def scored(spark, sf_dir):
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"))


@query(f"with {SCORED} select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as mean_y from s group by 1")
def ece_bins(spark, sf_dir):
    b = A.calibration_bins(scored(spark, sf_dir), "p", "y")
    return b.select("bin", "n", r("mean_p", 6).alias("mean_p"), r("mean_y", 6).alias("mean_y"))


@query(f"with {SCORED}, b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as my from s group by 1) select round(sum(n * abs(mp - my)) / sum(n), 6) as ece, cast(sum(n) as bigint) as n from b")
def expected_calibration_error(spark, sf_dir):
    return A.ece(scored(spark, sf_dir), "p", "y").select(r("ece", 6).alias("ece"), "n")


@query(f"""with {SCORED}, q as (select *, greatest(1e-6, least(1 - 1e-6, p)) as q from s) select toxic, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy, case when avg(y) * (1 - avg(y)) > 0 then round(1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))), 6) end as skill from q group by 1""")
def brier_logloss(spark, sf_dir):
    p = A.proper_scores(scored(spark, sf_dir), ["toxic"], "p", "y")
    return p.select("toxic", "n", *[r(c, 6).alias(c) for c in ("brier", "log_loss", "accuracy", "skill")])


@query(f"with {DAILY}, x as (select k, d, v, lead(v, 1) over w as a1, lead(v, 2) over w as a2, lead(v, 3) over w as a3 from daily window w as ({BY})), u as (select 1 as horizon, abs(a1 - v) as e from x union all select 2, abs(a2 - v) from x union all select 3, abs(a3 - v) from x) select horizon, round(avg(e), 2) as mae, count(e) as n from u where e is not null group by 1")
def horizon_mae_arrays(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = daily(spark, sf_dir).select(F.array(*[F.lead("v", h).over(w) for h in (1, 2, 3)]).alias("a"), F.array("v", "v", "v").alias("f"))
    return A.horizon_errors(d, "a", "f").select("horizon", r("mae", 2).alias("mae"), "n")


@query("""with e as (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as f from events) select f as from_category, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'view') as view from e where f is not null group by 1""")
def transition_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return A.transitions(e, ["user_id"], "o", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("""with x as (select date_trunc('month', o_orderdate)::date as month, o_totalprice as v from orders where month(o_orderdate) <> 7), m as (select month, quantile_cont(v, 0.5) as median, count(v) as n, min(v) as lo, max(v) as hi from x group by 1), s as (select cast(unnest(generate_series((select min(month) from m), (select max(month) from m), interval 1 month)) as date) as month)
select s.month, round(m.median, 3) as median, coalesce(m.n, 0) as n, round(m.lo, 2) as min, round(m.hi, 2) as max from s left join m using (month)""")
def monthly_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("month(o_orderdate) <> 7").withColumn("d", F.to_date("o_orderdate"))
    m = A.monthly_sample(o, "d", "o_totalprice")
    return m.select("month", r("median", 3).alias("median"), "n", r("min", 2).alias("min"), r("max", 2).alias("max"))


@query("""with x as (select l_shipmode_k as k, q, p, rank() over (partition by l_shipmode_k order by q) + (count(*) over (partition by l_shipmode_k, q) - 1) / 2.0 as a, rank() over (partition by l_shipmode_k order by p) + (count(*) over (partition by l_shipmode_k, p) - 1) / 2.0 as b from (select concat(l_returnflag, l_linestatus) as l_shipmode_k, l_quantity as q, l_extendedprice as p from lineitem))
select k, round(corr(a, b), 6) as spearman, round(corr(q, p), 6) as pearson, count(*) as n from x group by 1""")
def rank_correlation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    s = A.spearman(li, ["k"], "q", "p")
    return s.select("k", r("spearman", 6).alias("spearman"), r("pearson", 6).alias("pearson"), "n")


@query("with q as (select c_mktsegment, quantile_cont(c_acctbal, 1 / 3) as a, quantile_cont(c_acctbal, 2 / 3) as b from customer group by 1) select c_mktsegment, cast(cast(c_acctbal > a as int) + cast(c_acctbal > b as int) as int) as bucket, count(*) as n, round(avg(c_acctbal), 3) as mean from customer join q using (c_mktsegment) group by 1, 2")
def quantile_buckets(spark, sf_dir):
    d = A.quantile_buckets(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", [1 / 3, 2 / 3])
    return d.groupBy("c_mktsegment", "bucket").agg(F.count(F.lit(1)).alias("n"), r(F.avg("c_acctbal"), 3).alias("mean"))


@query("""with x as (select unnest(list_filter([case when true then 'all' end, case when l_quantity > 25 then 'large' end, case when l_discount >= 0.05 then 'discounted' end], lambda s: s is not null)) as stratum, l_extendedprice as p from lineitem) select stratum, count(*) as n, round(avg(p), 3) as mean from x group by 1""")
def overlapping_strata(spark, sf_dir):
    return A.by_strata(table(spark, sf_dir, "lineitem"), {"all": F.lit(True), "large": F.col("l_quantity") > 25, "discounted": F.col("l_discount") >= 0.05}, F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 3).alias("mean"))


@query("select year(o_orderdate) as y, count(o_totalprice) as n, round(avg(o_totalprice), 2) as mean, round(quantile_cont(o_totalprice, 0.5), 2) as median, round(stddev_samp(o_totalprice), 2) as std, round(quantile_cont(o_totalprice, 0.1), 2) as p10, round(quantile_cont(o_totalprice, 0.9), 2) as p90 from orders group by 1")
def describe_by_year(spark, sf_dir):
    d = A.describe(table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), ["y"], "o_totalprice")
    return d.select("y", "n", *[r(c, 2).alias(c) for c in ("mean", "median", "std", "p10", "p90")])


@query("with x as (select c_nationkey as k, list_sort(list(c_acctbal)) as a from customer group by 1) select k, a[least(cast(ceil((len(a) + 1) * 0.9) as int), len(a))] as upper from x")
def higher_order_statistic(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_list("c_acctbal").alias("a"))
    return c.select("k", A.higher_quantile(F.col("a"), 0.9).alias("upper"))


@query("select l_returnflag as k, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) as origin from lineitem group by 1")
def ordinary_least_squares(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("k")).agg(r(F.regr_slope("l_extendedprice", "l_quantity")).alias("slope"), r(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"), r(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"), r(A.origin_slope("l_quantity", "l_extendedprice")).alias("origin"))


@query("""with x as (select date_trunc('week', o_orderdate)::date as week, cast(extract(isodow from o_orderdate) as int) as wd, o_totalprice as v, o_orderkey as k from orders), y as (select week, wd, arg_max(v, k) as v from x group by 1, 2)
select week, round(max(v) filter (wd = 1), 2) as mon, round(max(v) filter (wd = 3), 2) as wed, round(max(v) filter (wd = 5), 2) as fri from y group by 1""")
def weekly_pivot_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("week", S.week_of("o_orderdate")).withColumn("wd", F.weekday("o_orderdate"))
    p = o.groupBy("week").pivot("wd", [0, 2, 4]).agg(F.max_by("o_totalprice", "o_orderkey"))
    return p.select("week", *[r(F.col(a), 2).alias(b) for a, b in (("0", "mon"), ("2", "wed"), ("4", "fri"))])


@query("select user_id, arg_max(case when event_type = 'purchase' then value end, (ts, event_id)) filter (event_type = 'purchase') as last_purchase, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def last_known_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"), F.col("event_type").alias("last_type"))
    return A.last_known_per_group(e, ["user_id"], ["ts", "event_id"], ["last_purchase", "last_type"])


@query("with x as (select n.n_nationkey, c.c_custkey, s.s_suppkey, case when c.c_acctbal < 0 then null else c.c_acctbal end as b from nation n left join customer c on c_nationkey = n_nationkey left join supplier s on s_nationkey = n_nationkey) select cast((c_custkey is null)::int + (s_suppkey is null)::int + (b is null)::int as int) as n_null, count(*) as n from x group by 1")
def null_counting(spark, sf_dir):
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    # Rows of a nation that agree in what is null count as one with their number, so a nation's customers never meet its suppliers one by one.
    known = lambda x: F.when(x.isNotNull(), F.lit(1))
    c = c.groupBy("c_nationkey", known(F.col("c_custkey")).alias("c_custkey"), known(F.when(~(F.col("c_acctbal") < 0), F.col("c_acctbal"))).alias("b")).agg(F.count(F.lit(1)).alias("nc"))
    s = s.groupBy("s_nationkey", known(F.col("s_suppkey")).alias("s_suppkey")).agg(F.count(F.lit(1)).alias("ns"))
    n = n.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("nn"))
    j = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").join(s, n["n_nationkey"] == s["s_nationkey"], "left")
    number = F.col("nn") * F.coalesce("nc", F.lit(1)) * F.coalesce("ns", F.lit(1))
    return j.groupBy(A.null_counts(j, ["c_custkey", "s_suppkey", "b"]).alias("n_null")).agg(F.sum(number).alias("n"))


@query("with w as (select user_id, date_trunc('week', ts)::date as week, count(*) as n from events group by 1, 2), x as (select *, row_number() over (partition by user_id order by n desc, week) as r from w) select user_id, week, n, cast(r as int) as place from x where r <= 2")
def top_weeks(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("user_id", S.week_of("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    o = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "week")
    return w.withColumn("place", F.row_number().over(o)).where("place <= 2")


RULES_SQL = """v as (select l_orderkey, l_linenumber, 'num_unusual' as code, 1 as severity from lineitem where l_extendedprice between 1000 and 60000 and (l_extendedprice < 2000 or l_extendedprice > 50000)
union all select l_orderkey, l_linenumber, 'num_out_of_bounds', 2 from lineitem where l_extendedprice > 0 and (l_extendedprice < 1000 or l_extendedprice > 60000)
union all select l_orderkey, l_linenumber, 'ratio', 2 from lineitem where not (l_extendedprice / nullif(l_quantity, 0) between 500 and 1800)
union all select l_orderkey, l_linenumber, 'ts_future', 2 from lineitem where l_shipdate > timestamp '1998-06-01' + interval 5 minute)"""


def rule_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rules = [*Q.number_rules("l_extendedprice", 1000, 60000, 2000, 50000), Q.ratio_rule("ratio", "l_extendedprice", "l_quantity", 500, 1800), *Q.timestamp_rules("l_shipdate", F.lit("1998-06-01").cast("timestamp"), least_year=1990)]
    return Q.violations(li, ["l_orderkey", "l_linenumber"], rules)


@query(f"with {RULES_SQL} select * from v")
def dq_violations(spark, sf_dir):
    return rule_rows(spark, sf_dir)


@query(f"with {RULES_SQL} select code, count(*) as n, max(severity) as severity from v group by 1")
def dq_summary(spark, sf_dir):
    return Q.summary(rule_rows(spark, sf_dir))


@query(f"with {RULES_SQL} select case coalesce(max(severity), -1) when -1 then 'ok' when 0 then 'info' when 1 then 'warn' else 'block' end as status, cast(coalesce(sum((severity = 0)::int), 0) as bigint) as n_info, cast(sum((severity = 1)::int) as bigint) as n_warn, cast(sum((severity = 2)::int) as bigint) as n_block from v")
def dq_rollup(spark, sf_dir):
    return Q.worst(rule_rows(spark, sf_dir))


@query(f"with {DAILY}, x as (select *, abs(ln(v / lag(v) over ({BY}))) / sqrt(datediff('day', lag(d) over ({BY}), d)) as m from daily) select k, d, case when m > 0.8 then 'jump_block' else 'jump_warn' end as code from x where m > 0.4")
def dq_jumps(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = daily(spark, sf_dir).withColumn("pv", F.lag("v").over(w)).withColumn("gap", F.datediff("d", F.lag("d").over(w)))
    return Q.violations(d, ["k", "d"], Q.jump_rules("v", F.col("pv"), F.col("gap"), 0.2)).select("k", "d", "code")


@query("select l_orderkey, l_linenumber, o_orderdate as prediction, 'l_shipdate' as input, l_shipdate as known_at from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate")
def leak_guard_violations(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", F.col("o_orderdate").alias("prediction"), "l_shipdate")
    return Q.leaks(j, ["l_orderkey", "l_linenumber"], "prediction", ["l_shipdate"]).withColumn("known_at", F.col("known_at").cast("timestamp_ntz"))


@query("select case when l_shipdate < timestamp '1993-01-01' then 'stale' when l_discount = 0 and l_tax = 0 then 'nulls' when l_returnflag = 'N' then 'no label' end as excl_reason, count(*) as n from lineitem group by 1")
def exclusion_reasons(spark, sf_dir):
    d = Q.excluded(table(spark, sf_dir, "lineitem"), [("stale", F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz")), ("nulls", (F.col("l_discount") == 0) & (F.col("l_tax") == 0)), ("no label", F.col("l_returnflag") == "N")])
    return d.groupBy("excl_reason").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(ts as date) as d, user_id, count(value) as n, round(round((max(value) - min(value)) / nullif(avg(value), 0), 9) * 100000) / 100000 as spread from events group by 1, 2 having count(value) > 1 and round((max(value) - min(value)) / nullif(avg(value), 0), 9) > 1.0")
def cross_source_spread(spark, sf_dir):
    d = Q.source_spread(table(spark, sf_dir, "events").withColumn("d", F.to_date("ts")), ["d", "user_id"], "value", 1.0)
    return d.select("d", "user_id", "n", (F.round(F.col("spread") * 100000) / 100000).alias("spread"))


@query("with x as (select l_orderkey as k, l_suppkey as t, count(*) as n, sum((l_discount <= 0)::int) as b from lineitem group by 1, 2) select k, cast(sum(n) as bigint) as n, cast(sum((n > 1)::int) as bigint) as repeated_times, cast(sum(b) as bigint) as bad_values, min(t) as first_ts, max(t) as last_ts from x group by 1")
def series_integrity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("t"), "l_discount")
    return Q.integrity(li, ["k"], "t", "l_discount")


@query("with x as (select user_id, cast(ts as date) as d, event_id, value, row_number() over (partition by user_id, cast(ts as date) order by value desc, case when event_id % 2 = 0 then 0 else 1 end, event_id) as r from events) select user_id, d, event_id, value from x where r = 1")
def pit_upsert_latest(spark, sf_dir):
    """Stored rows (even ids) upgraded by new ones (odd ids) where these are better; never downgraded."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_id", "value")
    w = Window.partitionBy("user_id", "d").orderBy(F.col("value").desc(), "event_id")

    def one(df):
        return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

    return K.upgraded(one(e.where("event_id % 2 = 0")), one(e.where("event_id % 2 = 1")), ["user_id", "d"], "value")


@query("with a as (select c_custkey, case when c_custkey % 3 = 0 then null else c_acctbal end as b from customer where c_custkey % 5 <> 0), n as (select c_custkey, c_acctbal + 1 as b from customer where c_custkey % 2 = 0) select coalesce(a.c_custkey, n.c_custkey) as c_custkey, round(coalesce(a.b, n.b), 2) as b from a full join n using (c_custkey)")
def pit_fill_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("b"))
    n = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("b"))
    return K.fill_missing(a, n, ["c_custkey"], ["b"]).select("c_custkey", r("b", 2).alias("b"))


@query("select o_custkey, o_orderkey from orders where o_orderkey % 2 = 1 and o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0) qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def pit_new_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    new = o.where("o_orderkey % 2 = 1").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return K.new_rows(o.where("o_orderkey % 2 = 0"), new, ["o_custkey"])


@query("with u as (select c_custkey as k, c_acctbal as v, 1 as o from customer where c_custkey % 2 = 0 union all select c_custkey, c_acctbal * 2, 2 from customer where c_custkey % 2 <> 0 or c_custkey % 3 = 0) select k, round(arg_max(v, o), 2) as v from u group by 1")
def union_newest_wins_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return K.newest_wins(c.where("k % 2 = 0"), c.where("k % 2 <> 0 or k % 3 = 0").withColumn("v", F.col("v") * 2), ["k"]).select("k", r("v", 2).alias("v"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, max(cast(json_extract_string(props, '$.k') as int)) as top from events group by 1")
def json_props_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").cast("int").alias("top"))


@query(r"""select page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') as lang, contains(lower(html), 'just a moment') or contains(lower(html), 'cf-challenge') or contains(lower(html), 'challenge-platform') as challenge from pages""")
def html_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    d = R.html_fields(p, "html", {"title": "<title>([^<]*)</title>", "lang": 'lang="([a-z]+)"'})
    return d.select("page_id", "title", "lang", R.is_challenge("html").alias("challenge"))


@query("""select l_orderkey, l_linenumber, round(ln(l_extendedprice / (l_quantity * 900)), 6) as ret, round(1000 / 31.1034768 * 83.0 * (1 + l_tax) * (22.0 / 24), 4) as landed, round(l_extendedprice * 24 / 22, 3) as k24, round(l_extendedprice * 10 * 1.12 * 1.03, 3) as cost, floor(10 * l_discount * 10 + 1e-9)::int as of_ten,
round(40000 - 20000 + case when l_extendedprice < 20000 then 10.0 * (20000 - l_extendedprice) when l_extendedprice > 40000 then 10.0 * (l_extendedprice - 40000) else 0 end, 2) as winkler, case when l_discount <= 0.02 then 'low' when l_discount <= 0.06 then 'mid' else 'high' end as tier from lineitem""")
def scalar_finance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r(S.log_return(F.col("l_quantity") * 900, "l_extendedprice"), 6).alias("ret"), r(S.landed_rate(F.lit(1000.0), F.lit(83.0), "l_tax")).alias("landed"), r(S.karat("l_extendedprice", 24), 3).alias("k24"), r(S.purchase_cost("l_extendedprice", 10, 0.12), 3).alias("cost"), S.times_of_ten(F.col("l_discount") * 10).alias("of_ten"), r(S.winkler(F.lit(20000.0), F.lit(40000.0), "l_extendedprice", 0.2), 2).alias("winkler"), S.tier("l_discount", [(0.02, "low"), (0.06, "mid")], "high").alias("tier"))


@query("with x as (select vec_id, list_transform(embedding, lambda e: cast(e as double)) as v from embeddings) select vec_id, round(list_min(v), 6) as lo, round(list_max(v), 6) as hi, cast(list_position(v, list_min(v)) - 1 as int) as argmin, len(v) - 3 as n_sums, round(v[1] + v[2] + v[3] + v[4], 6) as first_sum from x")
def array_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    k = S.k_sums("v", 4)
    return e.select("vec_id", r(F.array_min("v"), 6).alias("lo"), r(F.array_max("v"), 6).alias("hi"), S.argmin("v").alias("argmin"), F.size(k).cast("long").alias("n_sums"), r(F.element_at(k, 1), 6).alias("first_sum"))


@query("""select event_id, cast(ts + interval 330 minute as date) as local_day, extract(hour from ts + interval 330 minute) * 60 + extract(minute from ts + interval 330 minute) as minute, extract(hour from ts + interval 330 minute) >= 22 or extract(hour from ts + interval 330 minute) < 7 as quiet, event_type like 'p%' as derived from events""")
def scalar_clock(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", S.local_date("ts").alias("local_day"), S.minute_of_day("ts").cast("long").alias("minute"), S.quiet("ts").alias("quiet"), S.derived_source("event_type", "p").alias("derived"))


@query(f"""with {DAILY}, p as (select substr(a.d::varchar, 1, 4) as y, a.v - b.v as x from daily a join daily b on a.d = b.d where a.k = '1-URGENT' and b.k = '5-LOW' and a.v <> b.v), k as (select *, rank() over (partition by y order by abs(x)) + (count(*) over (partition by y, abs(x)) - 1) / 2.0 as r from p)
select y, count(*) as n, sum(case when x > 0 then r else 0 end) as w_plus, sum(case when x < 0 then r else 0 end) as w_minus, round((sum(case when x > 0 then r else 0 end) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24), 5) as z from k group by 1""")
def wilcoxon_ranks(spark, sf_dir):
    d = daily(spark, sf_dir)
    a, b = d.where("k = '1-URGENT'"), d.where("k = '5-LOW'").select("d", F.col("v").alias("w"))
    p = a.join(b, "d").select(F.year("d").cast("string").alias("y"), (F.col("v") - F.col("w")).alias("x"))
    return T.wilcoxon(p, ["y"], "x").select("y", "n", "w_plus", "w_minus", r("z", 5).alias("z"))


@query("""with p as (select c_nationkey as k, c_mktsegment as s, 1.0 / (1 + count(*) + c_nationkey) as p from customer group by 1, 2), i as (select *, count(*) over (partition by s) as m, row_number() over (partition by s order by p, k) as i from p)
select k, s, round(least(1, min(p * m / i) over (partition by s order by i rows between current row and unbounded following)), 6) as p_bh, round(least(1, p * m), 6) as p_bonferroni from i""")
def bh_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).agg((1.0 / (1 + F.count(F.lit(1)) + F.first("c_nationkey"))).alias("p"))
    d = T.benjamini_hochberg(p, ["s"], "p")
    return d.select("k", "s", r("p_bh", 6).alias("p_bh"), r("p_bonferroni", 6).alias("p_bonferroni"))


MISS = f"{DAILY}, b as (select k, d, v, quantile_cont(v, 0.9) over ({BY} rows between 60 preceding and 1 preceding) as q, count(v) over ({BY} rows between 60 preceding and 1 preceding) as c from daily), m as (select k, d, cast(v > q as int) as miss from b where c >= 20)"


def misses(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d").rowsBetween(-60, -1)
    d = daily(spark, sf_dir).withColumn("q", F.percentile("v", F.lit(0.9)).over(w)).withColumn("c", F.count("v").over(w)).where("c >= 20")
    return d.select("k", "d", (F.col("v") > F.col("q")).cast("int").alias("miss"))


@query(f"with {MISS}, x as (select k, count(*) as n, sum(miss) as x from m group by 1) select k, n, cast(x as bigint) as x, round(-2 * ((n - x) * ln(0.9) + x * ln(0.1) - (n - x) * ln(1 - x / n) - x * ln(x / n)), 5) as lr from x")
def kupiec_counts(spark, sf_dir):
    x = misses(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("miss").alias("x"))
    return x.select("k", "n", "x", r(T.kupiec(F.col("n"), F.col("x"), 0.1), 5).alias("lr"))


@query(f"with {MISS}, p as (select k, miss, lag(miss) over (partition by k order by d) as p from m) select k, count(*) filter (p = 0 and miss = 0) as n00, count(*) filter (p = 0 and miss = 1) as n01, count(*) filter (p = 1 and miss = 0) as n10, count(*) filter (p = 1 and miss = 1) as n11 from p where p is not null group by 1")
def christoffersen_counts(spark, sf_dir):
    return T.christoffersen(misses(spark, sf_dir), ["k"], "d", "miss").select("k", "n00", "n01", "n10", "n11")


@query(f"""with {DAILY}, l as (select k, d, abs(v - lag(v) over ({BY})) - abs(v - lag(v, 2) over ({BY})) as x from daily), c as (select k, d, x, x - avg(x) over (partition by k) as z from l where x is not null), g as (select *, lag(z, 1) over ({BY}) as z1, lag(z, 2) over ({BY}) as z2 from c),
s as (select k, count(*) as n, avg(x) as m, (sum(z * z) + 2 * (2.0 / 3) * coalesce(sum(z * z1), 0) + 2 * (1.0 / 3) * coalesce(sum(z * z2), 0)) / count(*) as v from g group by 1) select k, n, round(m, 3) as mean_diff, case when v > 0 then round(m / sqrt(v / n), 5) end as dm_stat from s""")
def diebold_mariano(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    d = daily(spark, sf_dir).withColumn("a", F.abs(F.col("v") - F.lag("v").over(w))).withColumn("b", F.abs(F.col("v") - F.lag("v", 2).over(w)))
    return T.diebold_mariano_by(d, ["k"], "d", "a", "b", 2).select("k", "n", r("mean_diff", 3).alias("mean_diff"), r("dm_stat", 5).alias("dm_stat"))


@query(f"with {DAILY}, x as (select k, d, count(n) over w as c, avg(n) over w as m, coalesce(var_pop(n) over w, 0) * count(n) over w as v from daily window w as ({BY} rows between unbounded preceding and current row)) select k, d, c as cs_n, round(m, 5) as cs_mean, round(m - sqrt((v + 1) * (2 * ln(20) + ln(v + 1))) / c, 5) as cs_lower, round(m + sqrt((v + 1) * (2 * ln(20) + ln(v + 1))) / c, 5) as cs_upper from x")
def confidence_sequence(spark, sf_dir):
    d = T.confidence_sequence(daily(spark, sf_dir), ["k"], "d", "n")
    return d.select("k", "d", "cs_n", r("cs_mean", 5).alias("cs_mean"), r("cs_lower", 5).alias("cs_lower"), r("cs_upper", 5).alias("cs_upper"))


@query(f"with {MISS}, x as (select k, count(*) as n, sum(1 - miss) as h from m group by 1), g as (select k, n, h, i * 0.009 as p from x, range(1, 100) t(i)) select k, round(ln(avg(exp(h * ln(p / 0.9) + (n - h) * ln((1 - p) / 0.1)))), 4) as log_e from g group by 1")
def coverage_e_value(spark, sf_dir):
    x = misses(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("miss")).alias("h"))
    return x.select("k", r(F.ln(T.coverage_e_value(F.col("h"), F.col("n"), 0.9))).alias("log_e"))


@query(f"""with {DAILY}, m as (select k, year(d) as y, count(*) as n, avg(v) as a, stddev_samp(v) as s from daily group by 1, 2), g as (select k, y, n, a / 200000 as acc, s / 100000 as brier, n % 7 / 50.0 as ece from m)
select k, y, n >= 30 and brier < 0.5 and acc > 0.72 and ece <= 0.1 as ok, case when n < 30 then 'too few folds' when not brier < 0.5 then 'brier not better' when not acc > 0.72 then 'accuracy not better' when ece > 0.1 then 'not calibrated' end as reason from g""")
def direction_gate(spark, sf_dir):
    m = daily(spark, sf_dir).groupBy("k", F.year("d").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
    g = m.select("k", "y", "n", F.lit(True).alias("significant"), (F.col("s") / 100000).alias("brier"), F.lit(0.5).alias("base_brier"), (F.col("a") / 200000).alias("accuracy"), F.lit(0.72).alias("base_accuracy"), (F.col("n") % 7 / 50.0).alias("ece"))
    ok, why = G.direction_gate()
    return g.select("k", "y", ok.alias("ok"), why.alias("reason"))


@query(f"""with {DAILY}, b as (select k, d, cast(v < 140000 as int) as b from daily), t as (select *, count(b) over w = 3 and min(b) over w = 1 as t from b window w as ({BY} rows between 2 preceding and current row))
select k, d, bool_or(t) over ({BY} rows between unbounded preceding and current row) as demoted from t""")
def sticky_demotion(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("breach", F.col("v") < 140000)
    return G.sticky(d, ["k"], "d", "breach").select("k", "d", "demoted")


@query("with x as (select user_id, ts, event_id, value, lag(value) over (partition by user_id order by ts, event_id) as p from events) select event_id, round(value - p, 6) as move from x where p is not null and value <> p and abs(value - p) >= 50")
def move_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return ST.move_alerts(e, ["user_id"], "o", "value", 50).select("event_id", r("move", 6).alias("move"))


@query("with x as (select *, sum((event_type not in ('error', 'view'))::int) over (partition by user_id order by ts, event_id) as i from events), y as (select event_id, sum((event_type in ('error', 'view'))::int) over (partition by user_id, i order by ts, event_id) as streak from x) select event_id, cast(streak as bigint) as streak from y where streak >= 2")
def failure_streaks(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return ST.failure_streak(e, ["user_id"], "o", ~F.col("event_type").isin("error", "view")).select("event_id", "streak")


@query("select event_type, user_id, cast(ts + interval 330 minute as date) as local_day, min(ts) as ts from events group by 1, 2, 3")
def once_per_local_day(spark, sf_dir):
    return ST.once_per_day(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts").select("event_type", "user_id", "local_day", "ts")


@query("select event_type, user_id, date_trunc('day', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def tumbling_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return e.groupBy("event_type", "user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total")).select("event_type", "user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""with x as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 43200000000 then 1 else 0 end as b from events), y as (select *, sum(b) over (partition by user_id order by ts) as g from x) select user_id, min(ts) as start, max(ts) + interval 12 hour as "end", count(*) as n from y group by user_id, g""")
def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query()
def cooldown_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    return ST.cooldown_batch(e, "user_id", "ts", "event_type", ST.Cooldown(quiet=(22, 7)))
