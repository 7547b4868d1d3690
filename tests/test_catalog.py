"""Every query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import pytest

from tests.compare import compare, connect
from tidemark import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, Q[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = Q[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark, con, sf_dir):
    """Queries without a cut: every day, every month of two points and every id."""
    daily = "(select distinct o_orderpriority as k, cast(o_orderdate as date) as d from orders)"
    n = {x: Q[x](spark, sf_dir).count() for x in ("kalman_levels", "back_adjusted_history", "theil_sen_every_month", "union_newest_wins_all")}
    days = con.execute(f"select count(*) from {daily}").fetchone()[0]
    months = con.execute(f"select count(*) from (select 1 from {daily} group by k, date_trunc('month', d) having count(*) > 1)").fetchone()[0]
    assert n == {"kalman_levels": days, "back_adjusted_history": days, "theil_sen_every_month": months, "union_newest_wins_all": con.execute("select count(*) from customer").fetchone()[0]}
