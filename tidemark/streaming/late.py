"""Records made when their outcome arrives: each decision gets one, and one that came too late to be a live call says so for good.

Event time is the decision's day, processing time the arrival. A decision that never gets an outcome gets no record, and a record is not revised by
what arrives later, so a rerun or a late repeat neither adds a live call nor turns one into another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_late(decision: str, arrived: str | Column, most_days: int = 3) -> Column:
    """Whether the decision's day lies more than `most_days` days before the arrival's."""
    return F.datediff(F.to_date(F.col(arrived) if isinstance(arrived, str) else arrived), F.to_date(decision)) > most_days


def first_records(df: DataFrame, keys: list[str], decision: str, arrived: str, most_days: int = 3) -> DataFrame:
    """The first arrival of each key and decision, with `late`; at equal arrivals the least of the other columns.

    Rows with a null key, decision or arrival make no record.
    """
    by = [*keys, decision]
    rest = [c for c in df.columns if c not in by and c != arrived]
    for c in [*by, arrived]:
        df = df.where(F.col(c).isNotNull())
    first = df.groupBy(*by).agg(F.min(F.struct(arrived, *rest)).alias("__first"))
    d = first.select(*by, *[F.col("__first")[c].alias(c) for c in [arrived, *rest]])
    return d.withColumn("late", is_late(decision, arrived, most_days))


def record_batches(stream: DataFrame, path: str, keys: list[str], decision: str, checkpoint: str, arrived: str | None = None, most_days: int = 3):
    """A stream writer that appends the records of each batch whose key and decision are not stored yet.

    arrived: the column of the arrival; without one the time of the batch, as `arrived`. A batch that is run again adds nothing.
    """
    from tidemark.sources.stores import append_new

    def add(batch: DataFrame, _: int) -> None:
        d = batch if arrived else batch.withColumn("arrived", F.current_timestamp())
        append_new(batch.sparkSession, first_records(d, keys, decision, arrived or "arrived", most_days), path, [*keys, decision])

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
