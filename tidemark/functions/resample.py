"""Bootstraps as joins: hash-drawn blocks meet block sums, and a draw is one group of a sum.

A draw of n values needs n / block rows (key, draw, start), made where draws have been spread over tasks; no task holds the draws of a key, and no index array
exists. Starts come from md5, so that any engine draws the same. kind "moving": blocks lie inside the series; "circular": they wrap around its end; block 1
draws single rows. The last block of a draw is cut so that each draw has n values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS, PART = 12, 65_536  # PART: blocks of a draw that one row stands for until draws have been spread


def drawn(seed: int, parts: list[Column], most: Column) -> Column:
    """A whole number in [0, most) from the hash of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") % most


def _spread_draws(keys: DataFrame, by: list[str], draws: int, blocks: Column, most: Column, seed: int) -> DataFrame:
    """keys with one row for each draw and block: draw, block_no, start."""
    d = keys.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    d = d.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1, F.lit(PART).cast("long"))))
    # A stated number of tasks: without it, the few rows before the second explode would be put into one.
    d = d.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "draw", "__from")
    d = d.withColumn("block_no", F.explode(F.sequence("__from", F.least(F.col("__from") + PART, blocks) - 1))).drop("__from")
    return d.withColumn("start", drawn(seed, [*[F.col(c) for c in by], F.col("draw"), F.col("block_no")], most))


def block_draws(df: DataFrame, by: list[str], order: str, value: str, block: int, draws: int, kind: str = "moving", seed: int = 7) -> DataFrame:
    """Mean of each draw: by, draw, draw_mean. Rows with a null value are left out; keys shorter than a moving block have no draws.

    A circular block is at most the series. Rows of a key have different orders. Null keys are keys.
    """
    w = Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("v"))
    d = d.withColumn("i", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    d = d.withColumn("b", F.least(F.lit(block).cast("long"), F.col("n")) if kind == "circular" else F.lit(block).cast("long"))
    keys = d.where("i = 0").select(*by, "n", "b").where("n >= b")
    keys = keys.withColumn("m", F.col("n") if kind == "circular" else F.col("n") - F.col("b") + 1).withColumn("blocks", F.ceil(F.col("n") / F.col("b")))
    if kind == "circular":
        d = d.unionByName(d.where("i < b - 1").withColumn("i", F.col("i") + F.col("n")))
    ahead = F.collect_list("v").over(Window.partitionBy(*by).orderBy("i").rowsBetween(0, block - 1))
    rest = (F.col("n") - (F.ceil(F.col("n") / F.col("b")) - 1) * F.col("b")).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    sums = d.withColumn("a", ahead).where("i < n").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("i").alias("__i"), total(F.slice("a", F.lit(1), F.col("b").cast("int"))).alias("whole"), total(F.slice("a", F.lit(1), rest)).alias("part"))
    g = _spread_draws(keys, by, draws, F.col("blocks"), F.col("m"), seed)
    on = F.col("start") == F.col("__i")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    piece = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("part")).otherwise(F.col("whole"))
    return g.join(sums.hint("shuffle_hash"), on).groupBy(*by, "draw").agg((F.sum(piece) / F.first("n")).alias("draw_mean"))


def cluster_draws(df: DataFrame, by: list[str], cluster: str, value: str, draws: int, seed: int = 7) -> DataFrame:
    """Mean of each draw of as many whole clusters as the key has, with replacement: by, draw, draw_mean. A cluster counts as one sum and one size, however
    many rows it has; rows with a null value are left out, a null cluster is one cluster."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("size"))
    sums = sums.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(cluster)).cast("long") - 1)
    keys = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    g = _spread_draws(keys, by, draws, F.col("m"), F.col("m"), seed)
    s = sums.select(*[F.col(c).alias(f"__{c}") for c in by], "__i", "s", "size")
    on = F.col("start") == F.col("__i")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return g.join(s.hint("shuffle_hash"), on).groupBy(*by, "draw").agg((F.sum("s") / F.sum("size")).alias("draw_mean"))


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with the columns of b where keys are equal, nulls included."""
    c = b.select(*[F.col(x).alias(f"__{x}") for x in by], *[x for x in b.columns if x not in by])
    on = F.lit(True)
    for x in by:
        on = on & F.col(x).eqNullSafe(F.col(f"__{x}"))
    return a.join(c, on, "left").drop(*[f"__{x}" for x in by])


def spread(draws: DataFrame, by: list[str], level: float = 0.95, name: str = "draw_mean") -> DataFrame:
    """For each key: n_draws, mean_of_draws, lower, upper, share_not_below_zero, share_not_above_zero."""
    tail = (1 - level) / 2
    share = lambda c: F.avg(c.cast("double"))
    return draws.groupBy(*by).agg(F.count(F.lit(1)).alias("n_draws"), F.avg(name).alias("mean_of_draws"), F.percentile(name, F.lit(tail)).alias("lower"), F.percentile(name, F.lit(1 - tail)).alias("upper"), share(F.col(name) >= 0).alias("share_not_below_zero"), share(F.col(name) <= 0).alias("share_not_above_zero"))


def bootstrap_mean(df: DataFrame, by: list[str], order: str, value: str, block: int, draws: int, kind: str = "moving", seed: int = 7) -> DataFrame:
    """For each key: n, mean, n_draws (0 where the series is shorter than a moving block), lower, upper at 95 %, share of draws not below and not above zero."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    return _joined(seen, spread(block_draws(df, by, order, value, block, draws, kind, seed), by), by).withColumn("n_draws", F.coalesce("n_draws", F.lit(0).cast("long")))


def difference_of_means(df: DataFrame, by: list[str], order: str, value: str, event: Column, block: int, draws: int, seed: int = 7) -> DataFrame:
    """One-sided test that event rows have the larger mean: single event rows are drawn, the others in circular blocks in their order.

    For each key: n_event, n_normal, means, observed_diff, ratio_of_means, lower, upper, p_one_sided (share of draws not above zero). Null where a side is empty.
    """
    d = df.where(F.col(value).isNotNull()).withColumn("__event", F.coalesce(event, F.lit(False)))
    a = block_draws(d.where("__event"), by, order, value, 1, draws, "circular", seed)
    b = block_draws(d.where("not __event"), by, order, value, block, draws, "circular", seed + 1).withColumnRenamed("draw_mean", "__other")
    diff = _joined(a, b, [*by, "draw"]).where("__other is not null").withColumn("__diff", F.col("draw_mean") - F.col("__other"))
    got = spread(diff, by, name="__diff").select(*by, "lower", "upper", F.col("share_not_above_zero").alias("p_one_sided"))
    at = {n: F.when(F.col("__event") == e, F.col(value).cast("double")) for n, e in (("event", True), ("normal", False))}
    seen = d.groupBy(*by).agg(*[F.count(c).alias(f"n_{n}") for n, c in at.items()], *[F.avg(c).alias(f"mean_{n}") for n, c in at.items()])
    seen = seen.withColumn("observed_diff", F.col("mean_event") - F.col("mean_normal")).withColumn("ratio_of_means", F.when(F.col("mean_normal") > 0, F.col("mean_event") / F.col("mean_normal")))
    return _joined(seen, got, by)
