"""Frequency sketches and membership filters as relations: partial sums before the shuffle, any size, no Python."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import xx_hash

DEPTH = 4
#: Epochs back that aging keeps; with 2**40 accesses an epoch, sums stay within 38 digits.
MEMORY = 84
#: A seeded 64-bit hash of a column; filters and what asks them must use the same.
Hash = Callable[[int, Column], Column]


def _width(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def cms_cells(key: Column, width: int, depth: int = DEPTH, hasher: Hash = xx_hash) -> Column:
    """The cells of a key: one bucket a row."""
    mask = _width(width) - 1
    return F.array(*[F.struct(F.lit(r).alias("row"), hasher(r, key).bitwiseAND(F.lit(mask)).alias("bucket")) for r in range(depth)])


def cms(rows: DataFrame, width: int, saturate: int = 255, depth: int = DEPTH, hasher: Hash = xx_hash) -> DataFrame:
    """Count-min sketch (row, bucket, cnt); counters stop at ``saturate`` (15 or 255)."""
    cells = rows.select(F.explode(cms_cells(F.col("key"), width, depth, hasher)).alias("c"))
    return cells.groupBy(F.col("c.row").alias("row"), F.col("c.bucket").alias("bucket")).agg(F.least(F.count(F.lit(1)), F.lit(saturate)).alias("cnt"))


def cms_halved(sketch: DataFrame) -> DataFrame:
    return sketch.withColumn("cnt", F.floor(F.col("cnt") / 2))


def cms_estimate(sketch: DataFrame, keys: DataFrame, width: int, depth: int = DEPTH, hasher: Hash = xx_hash) -> DataFrame:
    """(key, est) of each distinct key: the least of its cells."""
    cells = keys.select("key").distinct().select("key", F.explode(cms_cells(F.col("key"), width, depth, hasher)).alias("c")).select("key", "c.row", "c.bucket")
    return cells.join(sketch, ["row", "bucket"], "left").groupBy("key").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("est"))


def bloom_size(n: int, fp_rate: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n items."""
    bits = max(64, math.ceil(-n * math.log(fp_rate) / math.log(2) ** 2))
    return bits, min(16, max(1, round(bits / max(n, 1) * math.log(2))))


def _probes(key: Column, bits: int, hashes: int, hasher: Hash) -> Column:
    return F.array(*[F.pmod(hasher(i, key), F.lit(bits)) for i in range(hashes)])


def bloom(keys: DataFrame, bits: int, hashes: int, hasher: Hash = xx_hash) -> DataFrame:
    """Set bits in words of 64: (word, mask)."""
    at = keys.select(F.explode(_probes(F.col("key"), bits, hashes, hasher)).alias("b")).select(F.shiftright("b", 6).alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m"))
    return at.groupBy("word").agg(F.bit_or("m").alias("mask"))


def bloom_contains(filter_: DataFrame, keys: DataFrame, bits: int, hashes: int, hasher: Hash = xx_hash) -> DataFrame:
    """(key, maybe): false means certainly absent."""
    at = keys.select("key").distinct().select("key", F.explode(_probes(F.col("key"), bits, hashes, hasher)).alias("b")).select("key", F.shiftright("b", 6).alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m"))
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("m")) != 0, F.lit(False))
    return at.join(filter_, "word", "left").groupBy("key").agg(F.min(hit.cast("int")).alias("_h")).select("key", (F.col("_h") == 1).alias("maybe"))


def bloom_fill(filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """One row: set bits, fill ratio, estimated items."""
    x = F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("long")
    out = filter_.agg(x.alias("set_bits"))
    ratio = F.col("set_bits") / bits
    estimate = F.when(F.col("set_bits") >= bits, F.lit(bits // hashes)).otherwise((-F.lit(bits / hashes) * F.log(F.lit(1.0) - ratio)).cast("long"))
    return out.select("set_bits", ratio.alias("fill_ratio"), estimate.alias("estimated_count"))


def blocked_bloom(keys: DataFrame, blocks: int, hashes: int, hasher: Hash = xx_hash) -> DataFrame:
    """All bits of a key in one 512-bit block: (block, word, mask)."""
    at = _blocked(keys, blocks, hashes, hasher)
    return at.groupBy("block", "word").agg(F.bit_or("m").alias("mask"))


def _blocked(keys: DataFrame, blocks: int, hashes: int, hasher: Hash) -> DataFrame:
    bits = F.array(*[F.pmod(hasher(i + 1, F.col("key")), F.lit(512)) for i in range(hashes)])
    at = keys.select("key", F.pmod(hasher(0, F.col("key")), F.lit(blocks)).alias("block"), F.explode(bits).alias("b"))
    return at.select("key", "block", F.shiftright("b", 6).alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m"))


def blocked_contains(filter_: DataFrame, keys: DataFrame, blocks: int, hashes: int, hasher: Hash = xx_hash) -> DataFrame:
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("m")) != 0, F.lit(False))
    return _blocked(keys.select("key").distinct(), blocks, hashes, hasher).join(filter_, ["block", "word"], "left").groupBy("key").agg(F.min(hit.cast("int")).alias("_h")).select("key", (F.col("_h") == 1).alias("maybe"))


def blocked_fill(filter_: DataFrame, blocks: int) -> DataFrame:
    """Fill ratio of each block that has any bit."""
    return filter_.groupBy("block").agg((F.sum(F.bit_count("mask")) / 512).alias("fill_ratio"))


def blocked_fp_rate(filter_: DataFrame, blocks: int, hashes: int) -> DataFrame:
    """One row: the estimated rate of false positives, the mean over blocks of fill to the power of hashes."""
    return blocked_fill(filter_, blocks).agg((F.coalesce(F.sum(F.pow("fill_ratio", F.lit(hashes))), F.lit(0.0)) / blocks).alias("fp_rate"))


def member_figures(members: DataFrame, capacity: int) -> DataFrame:
    """One row of a filter with deletion: entries, capacity, load factor."""
    return members.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entries")).select("entries", F.lit(capacity).cast("long").alias("capacity"), (F.col("entries") / capacity).alias("load_factor"))


def tinylfu_estimate(sketch: DataFrame, seen: DataFrame, keys: DataFrame, width: int, hasher: Hash = xx_hash) -> DataFrame:
    """(key, est): the sketch's estimate, and one more for a key that has passed the door (``seen``)."""
    est = cms_estimate(sketch, keys, width, hasher=hasher)
    door = seen.select("key", F.lit(1).alias("_d")).distinct()
    return est.join(door, "key", "left").select("key", (F.col("est") + F.coalesce("_d", F.lit(0))).alias("est"))


def member_set(adds: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """A filter with deletion, exact: (key, n) of the copies that are left; contains is a semi join on it."""
    rows = adds.select("key", F.lit(1).alias("d"))
    if deletes is not None:
        rows = rows.unionByName(deletes.select("key", F.lit(-1).alias("d")))
    return rows.groupBy("key").agg(F.sum("d").alias("n")).where("n > 0")


def doorkeeper_second(log: DataFrame) -> DataFrame:
    """Keys seen at least twice: the first sighting stays at the door."""
    return log.where(F.col("op").isin("GET", "SET")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def aged_frequencies(log: DataFrame, window: int) -> DataFrame:
    """Access counts halved (rounded down) at the end of each epoch of ``window`` sequence numbers, up to the log's last.

    Since counts are whole, halving again and again with rounding equals one
    division of the sum of counts weighted by two to the epoch. Sums are exact in
    units of 2**-MEMORY; accesses more than MEMORY epochs before the last are
    less than that each, and count for nothing.
    """
    rows = log.where(F.col("op").isin("GET", "SET")).withColumn("e", F.floor(F.col("seq") / window))
    last = log.agg(F.floor(F.max("seq") / window).alias("_last"))  # one row
    counts = rows.groupBy("key", "e").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(last)).withColumn("age", F.col("_last") - F.col("e"))
    # 2 ** (MEMORY - age) in two factors that fit.
    power = lambda x: F.expr(f"cast(shiftleft(1L, cast({x} as int)) as decimal(20,0))")
    left = F.lit(MEMORY) - F.col("age")
    counts = counts.withColumn("left", left).withColumn("half", F.floor(F.col("left") / 2))
    weight = F.when(F.col("left") >= 0, (power("half") * power("left - half")).cast("decimal(32,0)"))
    summed = counts.groupBy("key").agg(F.sum(F.coalesce(F.col("n").cast("decimal(12,0)") * weight, F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")).alias("w"))
    return summed.select("key", F.expr(f"cast(w div cast({1 << (MEMORY + 1)} as decimal(38,0)) as bigint)").alias("freq"))
