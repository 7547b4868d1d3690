"""Session factory: UTC, adaptive execution and a shuffle width to suit the machine."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the engine's defaults; conf keys use _ for . (spark_sql_shuffle_partitions=8)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, str(v))
    return b.getOrCreate()
