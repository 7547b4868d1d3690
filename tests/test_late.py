"""Late records are flagged once; the stream gives what the batch gives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import late as L

KIND = "k string, d date, at timestamp, x double"


def day(n):
    return dt.date(2024, 1, n)


def at(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


BATCHES = [
    [("a", day(1), at(2), 1.0), ("a", day(1), at(2), 0.5), ("b", day(1), at(4, 23), 2.0), (None, day(1), at(2), 9.0), ("a", None, at(2), 9.0), ("a", day(7), None, 9.0)],
    [("a", day(1), at(9), 7.0), ("c", day(2), at(6, 0), 3.0), ("a", day(5), at(8), 4.0)],
    [("c", day(2), at(6, 1), 8.0), ("a", day(20), at(9), 5.0)],
]
WANT = {("a", day(1)): (0.5, False), ("b", day(1)): (2.0, False), ("c", day(2)): (3.0, True), ("a", day(5)): (4.0, False), ("a", day(20)): (5.0, False)}


def told(df):
    rows = df.collect()
    assert len(rows) == len({(r.k, r.d) for r in rows})
    return {(r.k, r.d): (r.x, r.late) for r in rows}


def test_stream_equals_batch(spark, tmp_path):
    """Three days are in time, a fourth is late; repeats change nothing; nulls make no record."""
    assert told(L.first_records(spark.createDataFrame([r for b in BATCHES for r in b], KIND), ["k"], "d", "at")) == WANT
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for i, rows in enumerate([*BATCHES, BATCHES[0]]):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{src}/b={i}")
        stream = spark.readStream.schema(KIND + ", b int").parquet(src).drop("b")
        L.record_batches(stream, out, ["k"], "d", str(tmp_path / "state"), "at").start().awaitTermination()
    assert told(spark.read.parquet(out)) == WANT


def test_time_of_the_batch_and_a_run_again(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("a", day(1), at(1), 1.0)], KIND).union(spark.createDataFrame([("b", day(1), at(1), 1.0)], KIND).withColumn("d", F.current_date())).coalesce(1).write.parquet(src)
    for state in ("one", "two"):  # a lost checkpoint reads all again
        L.record_batches(spark.readStream.schema(KIND).parquet(src), out, ["k"], "d", str(tmp_path / state)).start().awaitTermination()
    assert {r.k: r.late for r in spark.read.parquet(out).collect()} == {"a": True, "b": False} and spark.read.parquet(out).count() == 2


def test_no_rows(spark):
    assert L.first_records(spark.createDataFrame([], KIND), ["k"], "d", "at").count() == 0
