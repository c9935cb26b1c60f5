"""From the log to the stored state: the last write of each key, costs, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KeyspaceConfig


def live(as_of_ns: int | Column, expire_at: str = "expire_at") -> Column:
    """Alive up to and at the instant of expiry; zero never expires."""
    at = F.col(expire_at)
    return (at == 0) | (F.lit(as_of_ns) <= at if not isinstance(as_of_ns, Column) else as_of_ns <= at)


def expired(as_of_ns: int | Column) -> Column:
    return ~live(as_of_ns)


def normalised(log: DataFrame, config: KeyspaceConfig = KeyspaceConfig()) -> DataFrame:
    """Costs and expiry of SET rows: no or no positive cost is the cost function's or 1, no TTL the default's."""
    func = config.cost_func(F.col("value")).cast("long") if config.cost_func else F.lit(1).cast("long")
    ttl = F.when(F.coalesce(F.col("ttl_ns"), F.lit(0)) <= 0, F.lit(config.default_ttl_ns)).otherwise(F.col("ttl_ns"))
    return log.withColumn("cost", F.when(F.coalesce(F.col("cost"), F.lit(0)) <= 0, func).otherwise(F.col("cost"))).withColumn("expire_at", F.when(ttl > 0, F.col("ts_ns") + ttl).otherwise(F.lit(0)).cast("long"))


def since_clear(log: DataFrame) -> DataFrame:
    """Rows after the last CLEAR; one number is broadcast."""
    last = log.where("op = 'CLEAR'").agg(F.coalesce(F.max("seq"), F.lit(-(2**63))).alias("_cleared"))
    return log.join(F.broadcast(last), F.col("seq") > F.col("_cleared")).drop("_cleared")


def mutations(log: DataFrame, config: KeyspaceConfig = KeyspaceConfig(), cleared: bool = True) -> DataFrame:
    rows = since_clear(log) if cleared else log
    return normalised(rows.where(F.col("op").isin("SET", "DELETE")), config)


def materialise(log: DataFrame, config: KeyspaceConfig = KeyspaceConfig(), cleared: bool = True) -> DataFrame:
    """Stored entries (key, value, cost, expire_at, seq), expired ones included.

    One shuffle on the key; the maximum is combined before it, so a hot key
    sends one row from each task.
    """
    entry = F.struct("op", "value", "cost", "expire_at", "seq")
    last = mutations(log, config, cleared).groupBy("key").agg(F.max_by(entry, F.col("seq")).alias("e"))
    return last.where("e.op = 'SET'").select("key", "e.value", "e.cost", "e.expire_at", "e.seq")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after SET and DELETE rows (key, op, value, cost, expire_at, seq): replaces value, cost and expiry."""
    cols = ["key", "op", "value", "cost", "expire_at", "seq"]
    both = state.withColumn("op", F.lit("SET")).select(cols).unionByName(changes.select(cols))
    last = both.groupBy("key").agg(F.max_by(F.struct("op", "value", "cost", "expire_at", "seq"), F.col("seq")).alias("e"))
    return last.where("e.op = 'SET'").select("key", "e.value", "e.cost", "e.expire_at", "e.seq")


#: What a merged state has: entries (SET), tombstones (DELETE), and at most one CLEAR, whose key is null.
MERGED = ["key", "op", "value", "cost", "expire_at", "seq"]


def merged(old: DataFrame | None, log: DataFrame, config: KeyspaceConfig = KeyspaceConfig(), keep: int | None = None) -> DataFrame:
    """A state with its tombstones after more of the log, which may come in any order.

    The row with the highest sequence number of a key counts, deletions included, so
    that a SET that comes late stays dead. CLEAR kills what is before it, whenever
    it comes. Tombstones ``keep`` sequence numbers behind the newest row go, if it
    is given: nothing may come later than that. ``old`` is what this has returned
    before, or nothing; the parts' sizes don't matter, only one number is broadcast.
    """
    rows = normalised(log.where(F.col("op").isin("SET", "DELETE", "CLEAR")), config).select(MERGED)
    if old is not None:
        rows = old.select(MERGED).unionByName(rows)
    edge = rows.agg(F.coalesce(F.max(F.when(F.col("op") == "CLEAR", F.col("seq"))), F.lit(-(2**63))).alias("_cleared"), F.coalesce(F.max("seq"), F.lit(-(2**63))).alias("_newest"))
    rows = rows.withColumn("key", F.when(F.col("op") != "CLEAR", F.col("key"))).join(F.broadcast(edge), F.col("seq") >= F.col("_cleared"))
    if keep is not None:
        rows = rows.where((F.col("op") != "DELETE") | (F.col("seq") > F.col("_newest") - F.lit(keep)))
    # A CLEAR of the same number as a row can't be; rows at the edge are the CLEAR itself.
    last = rows.where((F.col("op") == "CLEAR") | (F.col("seq") > F.col("_cleared"))).groupBy("key").agg(F.max_by(F.struct(*MERGED[1:]), F.col("seq")).alias("e"))
    return last.select("key", "e.*")


def entries(merged_state: DataFrame) -> DataFrame:
    """The stored entries of a merged state."""
    return merged_state.where("op = 'SET'").select("key", "value", "cost", "expire_at", "seq")


def delete_many(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("key").distinct(), "key", "left_anti")


def deleted_count(state: DataFrame, keys: DataFrame) -> DataFrame:
    """How many of the keys were there."""
    return state.join(keys.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def overwritten(log: DataFrame, config: KeyspaceConfig = KeyspaceConfig()) -> DataFrame:
    """Values that a later SET of the same key replaced, with the sequence number of the SET that did."""
    from .metrics import prior_mutation

    rows = prior_mutation(mutations(log, config))
    return rows.where("op = 'SET' and p.op = 'SET'").select("key", F.col("p.value").alias("value"), F.col("p.cost").alias("cost"), F.col("p.seq").alias("seq"), F.col("seq").alias("by_seq"))
