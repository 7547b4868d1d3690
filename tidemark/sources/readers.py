"""Scans: parquet, JSON, JSON lines, XML and HTML, with cleansing that keeps filters and projections at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import positive

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the schema where the path does not exist."""
    from tidemark.sources.stores import recover

    recover(spark, path)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that parse; malformed ones are skipped."""
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    d = spark.read.schema(bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.where(F.col("_bad").isNull()).drop("_bad")


def plausible(df: DataFrame, ts: str, now: Column, least_year: int = 2000, slack: str = "5 minutes") -> DataFrame:
    """Rows whose time parses, is no epoch placeholder and does not lie ahead."""
    t = F.try_to_timestamp(F.col(ts)) if dict(df.dtypes)[ts] == "string" else F.col(ts).cast("timestamp")
    return df.where(t.isNotNull() & (F.year(t) >= least_year) & (t <= now + F.expr(f"INTERVAL {slack}")))


def sanitised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that are not finite or not above zero become null."""
    return df.withColumns({c: positive(c) for c in columns})


def with_columns(df: DataFrame, names: dict[str, str], kind: str = "double") -> DataFrame:
    """Columns renamed to the names given; one that is missing becomes null."""
    return df.select(*[(F.col(src).cast(kind) if src in df.columns else F.lit(None).cast(kind)).alias(out) for src, out in names.items()])


def api_rows(df: DataFrame, body: str, schema: str, path: str = "rows") -> DataFrame:
    """Rows of a JSON answer {path: [..]} held in a column; other columns come along."""
    d = df.withColumn("__j", F.from_json(body, f"{path} array<{schema}>")).withColumn("__r", F.explode(F.col("__j")[path]))
    return d.select(*[c for c in df.columns if c != body], "__r.*")


def xml_rows(df: DataFrame, body: str, entry: str, fields: dict[str, str]) -> DataFrame:
    """Entries of an XML document in a column; fields maps names to paths below the entry.

    Each entry is read by itself, so a field that it lacks is null. Entries do not nest.
    """
    tag = entry.rstrip("/").rpartition("/")[2]
    each = F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?/>|<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), F.lit(0))
    d = df.withColumn("__x", F.explode(each))
    return d.select(*[c for c in df.columns if c != body], *[F.expr(f"try_element_at(xpath(__x, '{tag}/{p}/text()'), 1)").alias(n) for n, p in fields.items()])


def html_fields(df: DataFrame, html: str, patterns: dict[str, str]) -> DataFrame:
    """Named groups by regular expression; an empty match is null."""
    return df.withColumns({n: F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for n, p in patterns.items()})


def is_challenge(html: str | Column) -> Column:
    """Whether a page is a bot challenge and no content."""
    h = F.lower(F.col(html) if isinstance(html, str) else html)
    return h.contains("just a moment") | h.contains("cf-challenge") | h.contains("challenge-platform")


def steps(df: DataFrame, verified_only: bool = True) -> DataFrame:
    return df.where(F.col("verified")) if verified_only else df


def flags(df: DataFrame, known: list[str], key: str = "name", on: str = "enabled") -> DataFrame:
    """Switches; an unknown name fails the query."""
    ok = F.col(key).isin(*known)
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown switch "), key)).cast("boolean"))).select(key, F.coalesce(on, F.lit(False)).alias(on))
