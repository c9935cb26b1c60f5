"""A bounded key space in one piece: writes, expiry, admission, eviction and counters under a configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KeyspaceConfig
from . import metrics as counters
from .retention import frequencies, ranked, within
from .state import materialise, since_clear


@dataclass(frozen=True)
class Bounded:
    """What a log leaves in a key space at an instant.

    ``retained`` is what stays within the limits of entries and cost, by use and then
    recency. Of the other live entries, those that the admission rule turns away are
    ``rejected`` and the rest ``evicted``, with the reason. A key that isn't there
    any more counts in none of the three.
    """

    retained: DataFrame
    evicted: DataFrame
    rejected: DataFrame
    log: DataFrame
    as_of_ns: int
    config: KeyspaceConfig

    def metrics(self) -> DataFrame:
        """The log's counters with evictions, cost_evicted and rejections; all are single rows."""
        out = self.evicted.agg(F.count(F.lit(1)).alias("evictions"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost_evicted"))
        no = self.rejected.agg(F.count(F.lit(1)).alias("rejections"))
        base = counters.metrics(self.log, self.as_of_ns, self.config).drop("rejections")
        return base.join(F.broadcast(out)).join(F.broadcast(no))


def bounded(log: DataFrame, as_of_ns: int, config: KeyspaceConfig) -> Bounded:
    """Apply a log under ``config``. Without limits everything live is retained."""
    rows = ranked(materialise(log, config), frequencies(since_clear(log)), as_of_ns)
    kept = within(rows, config.max_entries, config.max_cost)
    out = rows.join(kept.select("key"), "key", "left_anti")
    least = F.broadcast(kept.agg(F.min("freq").alias("_least")))  # one row
    judged = out.join(least).withColumn("_no", (F.col("freq") < F.coalesce("_least", F.lit(0))) & F.lit(config.admission == "tinylfu")).drop("_least")
    evicted = judged.where(~F.col("_no")).drop("_no").withColumn("reason", F.lit("capacity"))
    rejected = judged.where("_no").drop("_no").withColumn("reason", F.lit("admission"))
    return Bounded(kept, evicted, rejected, log, as_of_ns, config)
