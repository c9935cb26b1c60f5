"""Usage metrics from the log: hits and misses as of each read, mutations, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import KeyspaceConfig
from .state import normalised, since_clear

#: Sequence numbers of one stretch. A hot key's history is cut into stretches, so no task gets all of it.
STRETCH = 1 << 20


def prior_mutation(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Each row with ``p``, the last SET or DELETE of its key before it (null: none).

    Within (key, stretch) a window finds it; what a stretch takes over from
    earlier ones comes from the last mutation of each, one row a stretch.
    """
    entry = F.struct("op", "value", "cost", "expire_at", "seq", "ts_ns")
    mutation = F.when(F.col("op").isin("SET", "DELETE"), entry)
    cut = rows.withColumn("_s", F.floor(F.col("seq") / stretch))
    inside = W.partitionBy("key", "_s").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    near = cut.withColumn("_near", F.last(mutation, ignorenulls=True).over(inside))
    ends = cut.where(F.col("op").isin("SET", "DELETE")).groupBy("key", "_s").agg(F.max_by(entry, F.col("seq")).alias("_end"))
    spans = cut.select("key", "_s").distinct().join(ends, ["key", "_s"], "left")
    before = W.partitionBy("key").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("_far", F.last("_end", ignorenulls=True).over(before)).select("key", "_s", "_far")
    return near.join(carried, ["key", "_s"]).withColumn("p", F.coalesce("_near", "_far")).drop("_near", "_far", "_s")


def _alive(at: Column) -> Column:
    return (F.col("p.op") == "SET") & ((F.col("p.expire_at") == 0) | (at <= F.col("p.expire_at")))


def reads(log: DataFrame, config: KeyspaceConfig = KeyspaceConfig()) -> DataFrame:
    """GET rows with ``hit``: the key was set and alive at the time of the read."""
    rows = normalised(since_clear(log), config)
    return prior_mutation(rows).where("op = 'GET'").select("seq", "key", F.coalesce(_alive(F.col("ts_ns")), F.lit(False)).alias("hit"))


def metrics(log: DataFrame, as_of_ns: int, config: KeyspaceConfig = KeyspaceConfig()) -> DataFrame:
    """One row of counters since the last CLEAR.

    An expiration is a SET whose time ran out by ``as_of_ns`` before the key was
    set or deleted again; a DELETE counts if the key was there and alive. Nothing
    is dropped from buffers or rejected.
    """
    rows = prior_mutation(normalised(since_clear(log), config))
    alive = F.coalesce(_alive(F.col("ts_ns")), F.lit(False))
    n = lambda c: F.count_if(c)
    get, put, drop = F.col("op") == "GET", F.col("op") == "SET", F.col("op") == "DELETE"
    # A mutation that finds its predecessor run out proves one expiration; the last ones are judged at as_of.
    ran_out = F.col("op").isin("SET", "DELETE") & (F.col("p.op") == "SET") & (F.col("p.expire_at") > 0) & (F.col("ts_ns") > F.col("p.expire_at"))
    counted = rows.agg(n(get & alive).alias("hits"), n(get & ~alive).alias("misses"), n(put).alias("sets"), n(drop & alive).alias("deletes"), F.coalesce(F.sum(F.when(put, F.col("cost"))), F.lit(0)).alias("cost_added"), n(F.coalesce(ran_out, F.lit(False))).alias("_before"))
    entry = F.struct("op", "expire_at")
    last = normalised(since_clear(log), config).where(F.col("op").isin("SET", "DELETE")).groupBy("key").agg(F.max_by(entry, F.col("seq")).alias("e"))
    late = last.agg(F.count_if((F.col("e.op") == "SET") & (F.col("e.expire_at") > 0) & (F.col("e.expire_at") < F.lit(as_of_ns))).alias("_late"))
    out = counted.join(F.broadcast(late))
    return out.select("hits", "misses", "sets", "deletes", (F.col("_before") + F.col("_late")).alias("expirations"), F.lit(0).cast("long").alias("rejections"), F.lit(0).cast("long").alias("buffer_drops"), "cost_added", hit_ratio(F.col("hits"), F.col("misses")).alias("hit_ratio"))


def hit_ratio(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(F.lit(0.0))
