"""Quantile boosting: histogram trees on pinball gradients, grown for all folds and levels at once from partial sums.

A row is in one fold's training set, or is scored by it, or both copies exist (see `folds`). Features are cut into bins at the quantiles of a fold's own training
rows. Each level of a round's trees is one aggregation by (fold, level, node, feature, bin); splits, leaves and edges are bounded by folds, levels, nodes and bins, so they are broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Where cuts of the lineage go: the cluster's folder; a local one only in local mode."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must be set on a cluster")
        spark.sparkContext.setCheckpointDir(place or tempfile.mkdtemp())


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in that folder: computed once, and safe from lost executors."""
    place = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/boosting-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def folds(df: DataFrame, decision: str, known: str, starts: list, name: str = "fold") -> DataFrame:
    """Walk-forward folds beginning at `starts` (ascending): a row is scored in the fold its decision falls in, and trains every fold that begins after its outcome was known.

    Columns: the fold's number and `train`. The rows are copied once for each fold they train, so folds should be few.
    """
    at = [F.lit(s).cast(df.schema[decision].dataType) for s in starts]
    own = reduce(lambda a, b: a + b, [(F.col(decision) >= a).cast("int") for a in at]) - 1
    trains = F.array_compact(F.array(*[F.when(F.col(known) < a, F.struct(F.lit(i).alias("f"), F.lit(True).alias("t"))) for i, a in enumerate(at)]))
    scored = F.when(own >= 0, F.array(F.struct(own.alias("f"), F.lit(False).alias("t")))).otherwise(F.array().cast("array<struct<f:int,t:boolean>>"))
    return df.withColumn("__f", F.explode(F.concat(trains, scored))).select(*df.columns, F.col("__f.f").alias(name), F.col("__f.t").alias("train"))


def pinball(y: Column, estimate: Column, q: Column) -> Column:
    return F.greatest(q * (y - estimate), (q - 1) * (y - estimate))


def below(x: Column):
    return lambda e: e < x


def quantiles(df: DataFrame, by: list[str], features: list[str], label: str, levels: tuple[float, ...], train: str = "train", rounds: int = 30, depth: int = 2, rate: float = 0.1, bins: int = 32, least: int = 20, least_rows: int = 60) -> DataFrame:
    """Rows that do not train, once for each level, with `level` and `estimate`; null in folds of fewer than `least_rows` training rows.

    A leaf's step is the level's quantile of its residuals times `rate`. A null feature is in the lowest bin; a row without a label does not train. Leaves have
    `least` rows at least. Ties of splits go to the earlier feature, then to the lower cut. Quantiles of leaves above 10,000 rows are approximate.
    """
    shared_folder(df.sparkSession)
    key = [*by, "level"]
    use = F.col(train) & F.col(label).isNotNull()
    grid = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = df.where(use).groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[F.percentile_approx(F.col(c).cast("double"), grid, F.lit(10000)).alias(f"__e_{c}") for c in features]).where(F.col("__n") >= least_rows)
    bin_of = [F.size(F.filter(f"__e_{c}", below(F.col(c)))) for c in features]
    d = df.withColumn("__use", use).join(F.broadcast(edges), by, "left").withColumn("__bins", F.when(F.col("__n").isNotNull(), F.array(*[F.coalesce(b, F.lit(0)) for b in bin_of])))
    d = d.withColumn("level", F.explode(F.array(*[F.lit(float(q)) for q in levels]))).select(*df.columns, "__use", "__bins", "level")

    def leaf_values(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
        """The level's quantile of value in each group: one sketch for each level, chosen by the row's level."""
        pick = reduce(lambda c, q: c.when(F.col("level") == q, F.percentile_approx(F.when(F.col("level") == q, value), F.lit(float(q)), F.lit(10000))), levels[1:], F.when(F.col("level") == levels[0], F.percentile_approx(F.when(F.col("level") == levels[0], value), F.lit(float(levels[0])), F.lit(10000))))
        return rows.where("__use and __bins is not null").groupBy(*keys).agg(pick.alias("__step"))

    start = leaf_values(d, key, F.col(label).cast("double"))
    d = cut(d.join(F.broadcast(start), key, "left").withColumnRenamed("__step", "estimate"))
    for _ in range(rounds):
        d = d.withColumns({"__node": F.lit(0), "__g": F.col("level") - (F.col(label) < F.col("estimate")).cast("double")})
        for _ in range(depth):
            cells = d.where("__use and __bins is not null").select(*key, "__node", "__g", F.posexplode("__bins").alias("__pos", "__cut")).groupBy(*key, "__node", "__pos", "__cut").agg(F.sum("__g").alias("g"), F.count(F.lit(1)).alias("n"))
            w = Window.partitionBy(*key, "__node", "__pos")
            left = w.orderBy("__cut").rowsBetween(Window.unboundedPreceding, 0)
            c = cells.select(*key, "__node", "__pos", "__cut", F.sum("g").over(left).alias("gl"), F.sum("n").over(left).alias("nl"), F.sum("g").over(w).alias("gt"), F.sum("n").over(w).alias("nt"))
            gain = F.round(F.pow("gl", F.lit(2)) / F.col("nl") + F.pow(F.col("gt") - F.col("gl"), F.lit(2)) / (F.col("nt") - F.col("nl")) - F.pow("gt", F.lit(2)) / F.col("nt"), 6)
            c = c.where((F.col("nl") >= least) & (F.col("nt") - F.col("nl") >= least)).withColumn("gain", gain).where("gain > 0")
            best = c.groupBy(*key, "__node").agg(F.max_by(F.struct("__pos", "__cut"), F.struct("gain", -F.col("__pos"), -F.col("__cut"))).alias("__s"))
            right = F.coalesce((F.element_at("__bins", F.col("__s")["__pos"] + 1) > F.col("__s")["__cut"]).cast("int"), F.lit(0))
            d = d.join(F.broadcast(best), [*key, "__node"], "left").withColumn("__node", F.col("__node") * 2 + right).drop("__s")
        steps = leaf_values(d, [*key, "__node"], F.col(label) - F.col("estimate"))
        d = cut(d.join(F.broadcast(steps), [*key, "__node"], "left").withColumn("estimate", F.col("estimate") + rate * F.coalesce("__step", F.lit(0.0))).drop("__step", "__node", "__g"))
    return d.where(~F.col(train)).select(*[c for c in df.columns if c != train], "level", "estimate")
