"""The engine's queries over the driver's tables, by theme; each with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Daily series by priority: day, highest price, count.
DAILY = "daily as (select o_orderpriority as k, cast(o_orderdate as date) as d, max(o_totalprice) as v, count(*) as n from orders group by 1, 2)"


def query(sql: str | None = None, name: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its function's name; sql: the same for DuckDB."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def daily(spark, sf_dir):
    from pyspark.sql import functions as F

    from tidemark.sources.readers import table

    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
