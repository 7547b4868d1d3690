"""Tables on which queries of the third review failed or differed from their SQL."""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import functions as F

from tests.compare import compare, connect
from tidemark import catalog
from tidemark.functions import resample
from tidemark.operators import aggregates, hot, quality

Q, SQL = catalog.queries(), catalog.oracle_sql()
D0 = dt.datetime(1995, 1, 1)
ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def orders(spark, path, series):
    """A table of orders, one a day, from the prices of each priority."""
    rows = [(i * 1000 + j, j % 7, "O", float(v), D0 + dt.timedelta(days=j), k) for i, (k, prices) in enumerate(series.items()) for j, v in enumerate(prices)]
    spark.createDataFrame(rows, ORDER).write.parquet(f"{path}/orders.parquet")
    return str(path)


def same(spark, path, name):
    """The query's rows, once they are the SQL's."""
    con = connect(path)
    con.execute(f"create or replace view orders as select * from '{path}/orders.parquet/*.parquet'")
    assert compare(spark, con, path, Q[name], SQL[name]) is None
    return Q[name](spark, path).collect()


def test_comparison_of_one_common_day_and_of_none(spark, tmp_path):
    prices = [200000 + 1000 * (j * 7 % 11) for j in range(60)]
    path = orders(spark, tmp_path, {"none": prices[:30], "one": prices[:41], "many": prices})
    got = {(r["k"], r["name"]): r for r in same(spark, path, "challenger_comparison")}
    assert got["none", "hold"].coverage_n == 0 and got["none", "hold"].coverage_p_below is None
    assert got["one", "hold"].n == 1 and got["one", "hold"].gain is None and got["many", "hold"].gain is not None


def test_errors_that_are_all_alike(spark, tmp_path):
    nearly = [300000.0] * 45 + [249990.0] + [300000.0] * 4  # a small step beside large values: sums must be centred
    path = orders(spark, tmp_path, {"worse": [300000.0] * 50, "better": [200000.0] * 50, "nearly": nearly})
    got = {(r["k"], r["d"]): r for r in same(spark, path, "error_demotion_statistic")}
    last = (D0 + dt.timedelta(days=49)).date()
    assert got["worse", last].stat is None and got["worse", last].p_worse == 0 and got["worse", last].breach
    assert got["better", last].p_worse == 1 and not got["better", last].breach and got["nearly", last].stat is not None


def test_a_signal_that_never_fires(spark, tmp_path):
    path = orders(spark, tmp_path, {"falling": [300000 * 0.99**j for j in range(40)], "both": [200000 + 1000 * (j * j % 23) for j in range(90)]})
    got = {(r["k"], r["z_threshold"], r["horizon"]): r for r in Q["signal_cells"](spark, path).collect()}
    assert got["falling", 1.5, 1].b is None and got["falling", 1.5, 1].n > 30 and got["both", 0.5, 1].b is not None


def test_customers_do_not_meet_suppliers_one_by_one(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(0,), (1,)], "n_nationkey int").write.parquet(f"{path}/nation.parquet")
    spark.range(200_000).selectExpr("id as c_custkey", "0 as c_nationkey", "if(id % 4 = 0, -1.0D, 1.0D) as c_acctbal").write.parquet(f"{path}/customer.parquet")
    spark.range(100_000).selectExpr("id as s_suppkey", "0 as s_nationkey").write.parquet(f"{path}/supplier.parquet")
    assert {r.n_null: r.n for r in Q["null_counting"](spark, path).collect()} == {0: 150_000 * 100_000, 1: 50_000 * 100_000, 3: 1}


def test_pieces_of_large_numbers(spark):
    d = spark.range(400).selectExpr("'a' as k", "id * 100000000000000 as t", "id as v")
    got = hot.states_before(d, ["k"], ["t"], last={"before": F.col("v")}, rows=20).orderBy("t").collect()
    assert [r.before for r in got] == [None, *range(399)]


def test_a_spread_at_the_limit_whatever_the_order(spark):
    rows = [(i, v) for i, p in enumerate(itertools.permutations([0.1, 0.2, 0.4, 0.5])) for v in p] + [(-1, 0.0), (-1, 0.0)]
    d = spark.createDataFrame(rows, "m int, v double").coalesce(1)
    assert quality.source_spread(d, ["m"], "v", 4 / 3).count() == 0


def test_draws_are_made_in_many_tasks(spark):
    keys = spark.createDataFrame([("a", 200_000)], "k string, n long")
    d = resample._spread_draws(keys, ["k"], 3, F.col("n"), F.col("n"), 1)
    assert d.count() == 600_000 and d.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_ranks_in_pieces(spark, monkeypatch):
    d = spark.range(500).selectExpr("if(id % 9 = 0, null, 'a') as k", "cast(id * 37 % 101 as double) as x", "cast(id * 11 % 83 as double) as y")
    ranked = d.toPandas().groupby("k", dropna=False)
    want = {k if isinstance(k, str) else None: g.x.rank().corr(g.y.rank()) for k, g in ranked}
    whole = hot.pieces
    monkeypatch.setattr(hot, "pieces", lambda *a, **b: whole(*a, **b, rows=10))
    got = {r.k: r.spearman for r in aggregates.spearman(d, ["k"], "x", "y").collect()}
    assert set(got) == {"a", None} and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_integrity_tasks_follow_the_input(spark, sf_dir, monkeypatch):
    """Rows are dealt to a number of tasks that grows with the input, in which each moment of a key is whole; the results stay."""
    from tidemark.operators import quality as Q

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = []
    for mb in (1000, 0.001):
        monkeypatch.setattr(Q, "PIECE_MB", mb)
        out = Q.integrity(li, ["l_orderkey"], "l_suppkey", "l_discount")
        got.append((Q.pieces(li), sorted(tuple(x) for x in out.collect()), out._jdf.queryExecution().optimizedPlan().toString()))
    assert got[1][0] > 4 * got[0][0] and got[0][1] == got[1][1] and "RepartitionByExpression" in got[1][2]
