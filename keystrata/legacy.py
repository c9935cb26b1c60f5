"""The older, smaller interface: an immutable facade over (key, value, expire_at)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.state import live


@dataclass(frozen=True)
class CacheDriver:
    """Each change gives a new driver; rows stay where they are until read."""

    rows: DataFrame

    def get(self, key: str, as_of_ns: int) -> DataFrame:
        return self.rows.where((F.col("key") == key) & live(as_of_ns)).select("key", "value")

    def set(self, key: str, value, ttl_ns: int, as_of_ns: int) -> CacheDriver:
        """Put one row; a TTL of zero never ends, and takes an older one away."""
        spark = self.rows.sparkSession
        schema = self.rows.select("key", "value", "expire_at").schema
        row = spark.createDataFrame([(key, value, as_of_ns + ttl_ns if ttl_ns > 0 else 0)], schema)
        return CacheDriver(self.rows.where(F.col("key") != key).select("key", "value", "expire_at").unionByName(row))

    def remove(self, key: str) -> CacheDriver:
        return CacheDriver(self.rows.where(F.col("key") != key))

    def flush_keys(self, keys: DataFrame, as_of_ns: int) -> CacheDriver:
        """Drop those of the keys that have run out."""
        gone = self.rows.where(~live(as_of_ns)).join(keys.select("key").distinct(), "key", "left_semi").select("key")
        return CacheDriver(self.rows.join(gone, "key", "left_anti"))

    def remove_expired(self, as_of_ns: int) -> CacheDriver:
        return CacheDriver(self.rows.where(live(as_of_ns)))

    def truncate(self) -> CacheDriver:
        return CacheDriver(self.rows.where(F.lit(False)))

    def keys(self) -> DataFrame:
        return self.rows.select("key")

    def sizes(self) -> DataFrame:
        """One row: stored entries, and those queued for expiry."""
        return self.rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expire_at") > 0).alias("queued"))

    def close(self, as_of_ns: int) -> DataFrame:
        """The entries that have not run out."""
        return self.rows.where(live(as_of_ns))
