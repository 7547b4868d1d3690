"""Session helpers shared by the text operators: the shared folder, written tables, Arrow batches and components."""

from __future__ import annotations

import atexit
import gc
import math
import os
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.environ.get("TIDEMARK_TEST_DIR")
        if not at:
            at = os.environ["TIDEMARK_TEST_DIR"] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, at, True)
    return at.rstrip("/")


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch grow beyond BATCH_BYTES, however long the texts, so that a task's memory does not follow its rows' lengths."""
    if int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Workspace:
    """A folder of written tables. Writing a table cuts its lineage with files that outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, partition_by: list[str] | None = None, release: bool = True) -> DataFrame:
        """Write df as parquet and return the written table; shuffle files of the stages before it may then go.

        release False: for small tables, whose shuffle files need not go at once.
        """
        out = f"{self.at}/{name}-{uuid.uuid4().hex[:6]}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
        if release:
            self.release()
        return self.spark.read.schema(df.schema).parquet(out)

    def release(self) -> None:
        """Let the driver's cleaner see the plans that are out of use, so that their shuffle files are deleted."""
        for _ in range(2):  # the cleaner works beside us; give it the time to
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.25)

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            for f in {os.path.dirname(x) for x in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(conf).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size in bytes; no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, mb: float, least: int = 96) -> int:
    """How many groups of about `mb` MB the input makes; it grows with the input and is never below `least`."""
    return max(least, min(1 << 20, math.ceil(input_bytes(df) / (mb * 1e6))))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with fn(RecordBatch) -> iterable of dicts of columns."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for b in batches:
            for cols in fn(b):
                yield to_batch(cols, names)

    return df.mapInArrow(run, schema)


def to_batch(cols: dict, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (cols[n] for n in names)], names)


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Smallest vertex reachable from each vertex of an undirected edge list (a, b), as (id, component).

    Large stars and small stars in turn: every vertex hands the least vertex of its neighbourhood first to its larger, then to its
    smaller neighbours, until each component is one star. The rounds follow the logarithm of the longest path and have no cap.
    Least neighbours are written before they are joined, so that Spark may split the rows of a vertex with very many edges.
    Vertices without edges do not appear. Self loops and repeated edges do no harm; rows with a null end are left out.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = work.table(e.distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least", release=False)
        large = work.table(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", release=False)
        least = work.table(large.groupBy("a").agg(F.min("b").alias("m")), "least", release=False)
        own = least.select("a", F.col("m").alias("b"))
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = work.table(own.unionByName(down).distinct(), "small", release=False)
        work.drop(now, low, large, least)
        now = small
        heads = now.select(F.col("b").alias("a")).distinct()
        if not now.join(heads, "a", "left_semi").limit(1).count() and not now.groupBy("a").count().where("count > 1").limit(1).count():
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(heads.select(F.col("a").alias("id"), F.col("a").alias("component")))
