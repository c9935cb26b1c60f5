"""Point and batch lookups over a state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KeyspaceConfig
from ..functions.hashing import fnv1a
from .state import live


def get(state: DataFrame, key, as_of_ns: int) -> DataFrame:
    return state.where((F.col("key") == F.lit(key)) & live(as_of_ns))


def peek(state: DataFrame, key) -> DataFrame:
    """The entry whether expired or not."""
    return state.where(F.col("key") == F.lit(key))


def get_by_hash(state: DataFrame, key_hash: int, as_of_ns: int, config: KeyspaceConfig = KeyspaceConfig()) -> DataFrame:
    """Live entries whose key has this hash under the configured hasher (FNV-1a if none)."""
    hasher = config.key_hasher or fnv1a
    return state.where((hasher(F.col("key")) == F.lit(key_hash)) & live(as_of_ns))


def has(state: DataFrame, keys: DataFrame, as_of_ns: int) -> DataFrame:
    """(key, found) of each distinct key; leaves no access record."""
    there = state.where(live(as_of_ns)).select("key", F.lit(True).alias("_t"))
    return keys.select("key").distinct().join(there, "key", "left").select("key", F.coalesce("_t", F.lit(False)).alias("found"))


def get_many(state: DataFrame, keys: DataFrame, as_of_ns: int) -> DataFrame:
    """Entries of the keys that are there, each once."""
    return state.where(live(as_of_ns)).join(keys.select("key").distinct(), "key")


def get_batch(state: DataFrame, keys: DataFrame, as_of_ns: int) -> DataFrame:
    """(pos, key, value, found) for every asked position, repeats and misses too."""
    there = state.where(live(as_of_ns)).select("key", "value", F.lit(True).alias("_t"))
    return keys.select("pos", "key").join(there, "key", "left").select("pos", "key", "value", F.coalesce("_t", F.lit(False)).alias("found"))


def missing(state: DataFrame, keys: DataFrame, as_of_ns: int) -> DataFrame:
    return keys.select("key").distinct().join(state.where(live(as_of_ns)).select("key"), "key", "left_anti")


def batch_to_map(state: DataFrame, keys: DataFrame, as_of_ns: int) -> DataFrame:
    """One row with a map of the found keys; the map is as large as the batch, so batches are the caller's to bound."""
    found = get_many(state, keys, as_of_ns)
    return found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("entries"))


def length(state: DataFrame) -> DataFrame:
    """Stored entries, expired ones included."""
    return state.agg(F.count(F.lit(1)).alias("n"))
