"""Bounded retention: which entries stay under a limit of entries or cost.

Exact: entries are ranked by access frequency, then recency. No window over all
rows: ranks come from sums by frequency, then by stretches of the sequence
number within the frequency on the edge, then among the rows of one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .state import live

STRETCH = 1 << 16
#: Up to so many rows are found by a sort's head; beyond it, by sums of sums, as one task would have to hold them.
TOP_ROWS = 100_000


def frequencies(log: DataFrame) -> DataFrame:
    """Accesses of each key: reads and writes."""
    return log.where(F.col("op").isin("GET", "SET")).groupBy("key").agg(F.count(F.lit(1)).alias("freq"))


def ranked(state: DataFrame, freq: DataFrame, as_of_ns: int) -> DataFrame:
    return state.where(live(as_of_ns)).join(freq, "key", "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("long"))


def _prefix(rows: DataFrame, amount: Column, cap: int, stretch: int = STRETCH) -> DataFrame:
    """The longest head in order (freq desc, seq desc) whose amounts add up to ``cap`` at most."""
    # The edges below are one row each, so that the joins with them are no products.
    rows = rows.withColumn("_a", amount.cast("long")).withColumn("_s", F.floor(F.col("seq") / stretch))

    def edge(sums: DataFrame, order: str, taken: Column) -> DataFrame:
        """One row: the first group that doesn't fit whole (null: all do), and what is taken before it."""
        upto = taken + F.sum("_a").over(W.orderBy(F.desc(order)))
        first = sums.withColumn("_u", upto).where(F.col("_u") > cap)
        return first.agg(F.max_by(F.struct(order, (F.col("_u") - F.col("_a")).alias("taken")), order).alias("e"))

    by_freq = rows.groupBy("freq").agg(F.sum("_a").alias("_a"))
    e1 = F.broadcast(edge(by_freq, "freq", F.lit(0)).select(F.col("e.freq").alias("_f"), F.col("e.taken").alias("_t1")))
    at = rows.join(e1, F.col("freq") == F.col("_f"))
    e2 = F.broadcast(edge(at.groupBy("_s").agg(F.sum("_a").alias("_a"), F.max("_t1").alias("_t1")), "_s", F.col("_t1")).select(F.col("e._s").alias("_s2"), F.col("e.taken").alias("_t2")))
    inside = at.join(e2, F.col("_s") == F.col("_s2")).withColumn("_u", F.col("_t2") + F.sum("_a").over(W.orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)))
    last = inside.where(F.col("_u") <= cap).agg(F.min("seq").alias("_q"))
    limits = e1.join(e2).join(F.broadcast(last))
    head = (F.col("_f").isNull()) | (F.col("freq") > F.col("_f")) | ((F.col("freq") == F.col("_f")) & ((F.col("_s") > F.col("_s2")) | ((F.col("_s") == F.col("_s2")) & (F.col("seq") >= F.col("_q")))))
    return rows.join(F.broadcast(limits)).where(F.coalesce(head, F.lit(False))).drop("_a", "_s", "_f", "_t1", "_s2", "_t2", "_q")


def within(rows: DataFrame, max_entries: int | None, max_cost: int | None) -> DataFrame:
    """The longest head of ranked rows within both limits; both heads are of one order, so the shorter is in the longer."""
    if max_entries is not None:
        rows = head_rows(rows, max_entries)
    return _prefix(rows, F.col("cost"), max_cost) if max_cost is not None else rows


def head_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by use, then recency; each task sends its own first n."""
    return rows.orderBy(F.desc("freq"), F.desc("seq")).limit(n) if n <= TOP_ROWS else _prefix(rows, F.lit(1), n)


def top_entries(state: DataFrame, freq: DataFrame, n: int, as_of_ns: int) -> DataFrame:
    """The n most used live entries, the later written first among equals."""
    return head_rows(ranked(state, freq, as_of_ns), n)


def within_cost(state: DataFrame, freq: DataFrame, max_cost: int, as_of_ns: int) -> DataFrame:
    """Live entries by use as long as their summed cost stays within the limit."""
    return _prefix(ranked(state, freq, as_of_ns), F.col("cost"), max_cost)


def evicted(state: DataFrame, retained: DataFrame, as_of_ns: int) -> DataFrame:
    """Live entries that aren't retained, with the reason."""
    return state.where(live(as_of_ns)).join(retained.select("key"), "key", "left_anti").withColumn("reason", F.lit("capacity"))


def admit(incoming: DataFrame, victims: DataFrame) -> DataFrame:
    """(key, victim, admitted): a newcomer goes in if it is used as much as its victim at least. Pairs join on ``slot``."""
    a, b = incoming.select("slot", F.col("key"), F.col("freq").alias("_i")), victims.select("slot", F.col("key").alias("victim"), F.col("freq").alias("_v"))
    return a.join(b, "slot").select("key", "victim", (F.col("_i") >= F.col("_v")).alias("admitted"))


def sample_size(entries: int) -> int:
    """Entries that are looked at for a victim."""
    return entries if entries < 100 else 10 if entries < 1_000 else 15 if entries < 10_000 else 20


def sample(state: DataFrame, entries: int | None = None, seed: int = 1) -> DataFrame:
    """A seeded sample without replacement, ordered by a hash of the key: the same on any layout.

    Its size follows from the number of entries, which is counted if it isn't given.
    """
    n = state.count() if entries is None else entries
    return state.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary")), "key").limit(sample_size(n))
