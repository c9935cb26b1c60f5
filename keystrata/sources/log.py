"""The mutation log: where it comes from, and its compacted form on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_NS = 3_600_000_000_000
LOG = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("ts_ns", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", T.StringType(), False), T.StructField("value", T.DoubleType()), T.StructField("cost", T.LongType()), T.StructField("ttl_ns", T.LongType())])
OPS = ("SET", "DELETE", "CLEAR", "GET", "HAS")


def epoch_ns(ts: Column | str) -> Column:
    """Nanoseconds since 1970 of a timestamp with or without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) * 1000


def event_log(events: DataFrame) -> DataFrame:
    """Events as a log: errors delete, views and clicks read, the rest set; purchases live six hours."""
    kind = F.col("event_type")
    op = F.when(kind == "error", "DELETE").when(kind.isin("view", "click"), "GET").otherwise("SET")
    ttl = F.when(kind == "purchase", F.lit(6 * HOUR_NS)).otherwise(F.lit(0))
    return events.select(F.col("event_id").alias("seq"), epoch_ns("ts").alias("ts_ns"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), "value", (F.length("props") + 1).cast("long").alias("cost"), ttl.cast("long").alias("ttl_ns"))


def items_log(items: DataFrame, op: str = "SET", first_seq: int = 0) -> DataFrame:
    """Batch items (key, value[, cost, ttl_ns]) as log rows, numbered without a shuffle."""
    has = set(items.columns)
    col = lambda n, kind: (F.col(n) if n in has else F.lit(None)).cast(kind).alias(n)
    return items.select((F.monotonically_increasing_id() + first_seq).alias("seq"), F.lit(0).cast("long").alias("ts_ns"), F.lit(op).alias("op"), "key", "value" if "value" in has else F.lit(None).alias("value"), col("cost", "long"), F.coalesce(col("ttl_ns", "long"), F.lit(0)).alias("ttl_ns"))


def checked(log: DataFrame) -> DataFrame:
    """The log with null keys refused when a row is read (CLEAR needs none)."""
    bad = F.col("key").isNull() & (F.col("op") != "CLEAR")
    return log.withColumn("key", F.when(bad, F.raise_error(F.lit("null key"))).otherwise(F.col("key")))


def write_state(state: DataFrame, path: str, files: int | None = None) -> None:
    """Compacted state as Parquet in key order, so that a prefix or key reads few row groups."""
    ranged = state.repartitionByRange(files, "key") if files else state.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
