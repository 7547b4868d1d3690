"""Point-in-time stores: idempotent appends, upgrades, fills and retention, as plans over the stored and the new rows.

Each returns the next state (or the rows to append); `replace` and `append` write it. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the first in order of the other columns, the same one each time."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in df.columns if c not in keys], F.lit(0))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def new_rows(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not stored; of repeated new keys the first in order of the other columns stays."""
    n, s = one_per_key(new, keys), stored.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return n.join(s, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")


def upgraded(stored: DataFrame, new: DataFrame, keys: list[str], better: str) -> DataFrame:
    """One row a key: the one with the higher `better`; the stored one where equal."""
    both = stored.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(better).desc_nulls_last(), "__o")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__o")


def fill_missing(stored: DataFrame, new: DataFrame, keys: list[str], columns: list[str], insert: bool = True) -> DataFrame:
    """Stored values stay; only nulls in `columns` take the new value. insert: keys that are only new come in, with nulls in the other columns."""
    n = one_per_key(new, keys).select(*[F.col(c).alias(f"__{c}") for c in [*keys, *columns]])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    j = stored.join(n, on, "full_outer" if insert else "left")
    return j.select(*[F.coalesce(c, f"__{c}").alias(c) if c in [*keys, *columns] else F.col(c) for c in stored.columns])


def newest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("__o").desc())
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__o")


def merge_logs(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return newest_wins(b, a, keys).orderBy(*order)


def pruned(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(ts).cast("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS"))


def scores_only(df: DataFrame, levels: list[str]) -> DataFrame:
    """For publication: without price levels."""
    return df.drop(*levels)


def may_publish(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """new, or nothing if what is stored is newer in `order` (code time, then run time)."""
    last = stored.agg(F.max(F.struct(*order)).alias("__last"))
    return new.crossJoin(F.broadcast(last)).where(F.col("__last").isNull() | (F.struct(*order) > F.col("__last"))).drop("__last")


MARK = "_REPLACES_OLD"  # lies in a state that was moved in, until the one before it is deleted


def replace(df: DataFrame, path: str) -> None:
    """Write beside the target, move the old state aside, move the new one in and only then delete the old one.

    The new state carries a mark before it is moved in, so whoever opens the store after a crash (`recover`, which every reader and writer
    here calls first) can tell a finished move from a store that somebody else began anew while the state lay aside. One writer at a time; a
    move must be atomic, as it is in a file system.
    """
    spark = df.sparkSession
    recover(spark, path)
    at = path.rstrip("/")
    tmp, aside = f"{at}.next-{uuid.uuid4().hex[:8]}", f"{at}.old"
    df.write.parquet(tmp)
    fs, (target, source, old, mark, placed) = _files(spark, at, tmp, aside, f"{tmp}/{MARK}", f"{at}/{MARK}")
    fs.create(mark).close()
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{at} could not be moved aside")
    if not fs.rename(source, target):
        fs.rename(old, target)
        raise OSError(f"{tmp} could not be moved to {at}")
    fs.delete(old, True)
    fs.delete(placed, False)


def recover(spark: SparkSession, path: str) -> None:
    """Undo or finish a `replace` that was broken off. Nothing is deleted unless a newer, whole state is in place.

    A store without the mark beside a state that lies aside was begun by a writer that did not recover: both are left as they are and an error names them.
    """
    at = path.rstrip("/")
    fs, (target, old, placed, whole) = _files(spark, at, f"{at}.old", f"{at}/{MARK}", f"{at}/_SUCCESS")
    if not fs.exists(old):
        return
    if not fs.exists(target):
        if not fs.rename(old, target):
            raise OSError(f"{at}.old could not be moved back")
    elif fs.exists(placed) and fs.exists(whole):
        fs.delete(old, True)
        fs.delete(placed, False)
    else:
        raise OSError(f"{at} was begun anew while its state lay in {at}.old; merge them by hand")


def opened(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The store's rows after `recover`; none where there is no store yet."""
    from tidemark.sources.readers import parquet_or_empty

    recover(spark, path)
    return parquet_or_empty(spark, path, schema)


def _files(spark: SparkSession, *paths: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(conf), found


def append_new(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key is not stored yet: a second run adds nothing."""
    new_rows(opened(spark, path, new.schema), new, keys).write.mode("append").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
