"""Ordered operators for keys that hold a large share of all rows: a key's timeline is cut into pieces, and states are carried from piece to piece.

Keys with more rows than a piece get splitters: approximate quantiles of their times, one for each piece. Rows with equal time stay together. Each piece is one
window partition, so a key with all rows runs in many tasks; what a piece leaves to the later ones is one row, and only those rows meet in one window.
The splitters are bounded: pieces grow with the table so that there are at most MOST_PIECES of them, which is what makes them fit for broadcast. They only
decide where work goes, so a quantile that is off moves no result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 500_000
MOST_PIECES = 20_000


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by])


def pieces(df: DataFrame, by: list[str], ts: str, rows: int = ROWS, most: int = MOST_PIECES, name: str = "piece") -> DataFrame:
    """df with the number of the piece of its key that each row is in, ascending with ts; 0 for keys of at most `rows` rows, and for null times.

    Costs one pass that counts the keys and one over the hot keys' times. `rows` is raised where more than `most` pieces would come of it.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    # Hot keys are at most total / rows, a bounded list once rows >= total / most.
    total = counts.agg(F.sum("__n")).first()[0] or 0
    rows = max(rows, -(-total // most), 1)
    if total <= rows:
        return df.withColumn(name, F.lit(0))
    hot = counts.where(F.col("__n") > rows).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.ceil(F.col("__n") / rows).cast("int").alias("__k"))
    kind = df.schema[ts].dataType
    at = F.col(ts).cast("double" if isinstance(kind, T.FractionalType) else "long") if isinstance(kind, T.NumericType) else F.unix_micros(F.col(ts).cast("timestamp"))
    times = df.where(F.col(ts).isNotNull()).withColumn("__at", at).join(F.broadcast(hot), _same(by))
    # A fine grid of quantiles serves keys of any number of pieces: a key takes every (GRID / k)-th of them.
    widest = hot.agg(F.max("__k")).first()[0]
    if widest is None:
        return df.withColumn(name, F.lit(0))
    grid = [i / widest for i in range(1, widest)]
    cuts = times.groupBy(*[f"__by_{c}" for c in by]).agg(F.max("__k").alias("__k"), F.percentile_approx("__at", F.array(*[F.lit(g) for g in grid]), F.lit(max(1000, 20 * widest))).alias("__g"))
    own = F.transform(F.sequence(F.lit(1), F.col("__k") - 1), lambda i: F.element_at("__g", F.greatest(F.lit(1), F.least(F.size("__g"), F.round(i * widest / F.col("__k")).cast("int")))))
    # The splitters, at most `most` numbers, are fixed here; a row finds its place among them by halving, not by a pass over them.
    found = cuts.select(*[f"__by_{c}" for c in by], F.array_distinct(F.array_sort(own)).alias("__cuts")).collect()
    lists = [np.array(row["__cuts"]) for row in found]
    fields = [T.StructField(f"__by_{c}", df.schema[c].dataType) for c in by] + [T.StructField("__key", T.IntegerType())]
    numbered = df.sparkSession.createDataFrame([(*row[:-1], i) for i, row in enumerate(found)], T.StructType(fields))

    @F.pandas_udf("int")
    def place(key: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(key), np.int32)
        for i in np.unique(key[key >= 0]):
            out[key == i] = np.searchsorted(lists[i], x[key == i].to_numpy(), "left")
        return pd.Series(out)

    d = df.withColumn("__at", at).join(F.broadcast(numbered), _same(by), "left")
    got = place(F.coalesce("__key", F.lit(-1)), F.coalesce("__at", F.lit(0).cast(times.schema["__at"].dataType)))
    return d.withColumn(name, F.when(F.col("__at").isNotNull(), got).otherwise(0)).drop("__at", "__key", *[f"__by_{c}" for c in by])


def _carried(d: DataFrame, by: list[str], value: str, at: list[str]) -> DataFrame:
    """Keys (as __by_...), __piece and __carry, the last non-null value of the pieces before it, for pieces after a key's first: a bounded list."""
    keys = [f"__by_{c}" for c in by]
    later = d.where("piece > 0").select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("piece").alias("__piece")).distinct()
    hot = d.join(F.broadcast(later.select(*keys).distinct()), _same(by), "left_semi").where(F.col(value).isNotNull())
    last = hot.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("piece").alias("__piece")).agg(F.max_by(value, F.struct(*at)).alias("__last"))
    both = last.unionByName(later.withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType))).groupBy(*keys, "__piece").agg(F.first("__last", ignorenulls=True).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    return both.select(*keys, "__piece", F.last("__last", ignorenulls=True).over(w).alias("__carry")).where("__piece > 0")


def fill_forward(df: DataFrame, by: list[str], ts: str, columns: list[str], rows: int = ROWS, most: int = MOST_PIECES) -> DataFrame:
    """df with <column>_filled: the last value that is not null at or before each row. Rows of a key have different times, none of them null."""
    d = pieces(df, by, ts, rows, most)
    w = Window.partitionBy(*by, "piece").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        carry = _carried(d, by, c, [ts])
        here = F.last(c, ignorenulls=True).over(w)
        d = d.withColumn(f"__{c}_here", here).join(F.broadcast(carry), _same(by) & (F.col("piece") == F.col("__piece")), "left")
        d = d.withColumn(f"{c}_filled", F.coalesce(f"__{c}_here", "__carry")).drop(f"__{c}_here", "__carry", "__piece", *[f"__by_{x}" for x in by])
    return d.drop("piece")


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], allow_exact: bool = True, rows: int = ROWS, most: int = MOST_PIECES) -> DataFrame:
    """left with `columns` and right_ts of the latest right row of its key that is not after it (before it, unless allow_exact).

    The same rows as the plain as-of join; keys with more than `rows` rows of both sides are cut. A left row without a time or with a null key matches
    nothing. Several right rows at one (key, time) must be reduced first.
    """
    names, kept = left.columns, [right_ts, *[c for c in columns if c != right_ts]]
    l = left.select(*by, F.col(left_ts).cast("timestamp").alias("ts"), F.lit(1).alias("side"), F.struct(*names).alias("row"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [right_ts, *by]])
    r = right.where(known).select(*by, F.col(right_ts).cast("timestamp").alias("ts"), F.lit(0 if allow_exact else 2).alias("side"), F.struct(*kept).alias("match"))
    d = l.withColumn("match", F.lit(None).cast(r.schema["match"].dataType)).unionByName(r.withColumn("row", F.lit(None).cast(l.schema["row"].dataType)))
    d = pieces(d, by, "ts", rows, most)
    here = F.last("match", ignorenulls=True).over(Window.partitionBy(*by, "piece").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0))
    carry = _carried(d.select(*by, "piece", "ts", "side", "match"), by, "match", ["ts", "side"])
    out = d.withColumn("__here", here).where("row is not null").join(F.broadcast(carry), _same(by) & (F.col("piece") == F.col("__piece")), "left")
    got = F.when(F.col("ts").isNotNull(), F.coalesce("__here", "__carry"))
    return out.withColumn("__got", got).select(*[F.col("row")[c].alias(c) for c in names], *[F.col("__got")[c].alias(c) for c in kept])


def states_before(df: DataFrame, by: list[str], order: list[str], last: dict[str, Column] | None = None, top: dict[str, Column] | None = None, rows: int = ROWS, most: int = MOST_PIECES) -> DataFrame:
    """df with running states of the rows before each one in its key: `last` the last value that is not null, `top` the highest.

    `order` begins with a number or time, by which large keys are cut; rows that agree in all of it are in no stated order. A null there comes first.
    """
    last, top = last or {}, top or {}
    d = df.withColumns({f"__v_{n}": c for n, c in {**last, **top}.items()})
    d = pieces(d, by, order[0], rows, most)
    w = Window.partitionBy(*by, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys, at = [f"__by_{c}" for c in by], F.struct(*order)
    one = d.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("piece").alias("__piece")).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(f"__c_{n}") for n in last], *[F.max(f"__v_{n}").alias(f"__c_{n}") for n in top])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = one.withColumns({f"__c_{n}": F.last(f"__c_{n}", ignorenulls=True).over(before) for n in last} | {f"__c_{n}": F.max(f"__c_{n}").over(before) for n in top})
    carried = carried.where("__piece > 0").drop("__rows")
    here = {f"__h_{n}": F.last(f"__v_{n}", ignorenulls=True).over(w) for n in last} | {f"__h_{n}": F.max(f"__v_{n}").over(w) for n in top}
    out = d.withColumns(here).join(F.broadcast(carried), _same(by) & (F.col("piece") == F.col("__piece")), "left")
    out = out.withColumns({n: F.coalesce(f"__h_{n}", f"__c_{n}") for n in last} | {n: F.greatest(f"__h_{n}", f"__c_{n}") for n in top})
    return out.select(*df.columns, *last, *top)
