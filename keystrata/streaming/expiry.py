"""A key space over a stream of mutations: state per key, event-time timers for expiry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql import types as T

from ..config import KeyspaceConfig
from ..operators.state import entries, merged

EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("event", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("at_ns", T.LongType())])
ENTRY = T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("expire_at", T.LongType()), T.StructField("dead", T.BooleanType())])


class KeyProcessor(StatefulProcessor):
    """Emits ``set``, ``overwrite``, ``delete`` and ``expire`` events.

    Rows of a batch apply by sequence number; one older than what the key has is
    late and ignored. A timer whose time isn't the entry's any more is stale.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.entry.get() if self.entry.exists() else None
        out = []
        for r in sorted(rows, key=lambda r: r.seq):
            if now is not None and r.seq <= now[0]:
                continue
            alive = now is not None and not now[3] and (now[2] == 0 or r.ts_ns <= now[2])
            if r.op == "SET":
                expire = r.ts_ns + r.ttl_ns if r.ttl_ns > 0 else 0
                out.append(Row(key=key[0], event="overwrite" if alive else "set", value=r.value, at_ns=r.ts_ns))
                now = (r.seq, r.value, expire, False)
                if expire:
                    # Alive at the instant itself: the timer is for the millisecond after.
                    self.handle.registerTimer(expire // 1_000_000 + 1)
            elif r.op == "DELETE":
                if alive:
                    out.append(Row(key=key[0], event="delete", value=now[1], at_ns=r.ts_ns))
                now = (r.seq, None, 0, True)
        if now is not None:
            self.entry.update(now)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists():
            seq, value, expire, dead = self.entry.get()
            if not dead and expire and expire // 1_000_000 + 1 == expiredTimerInfo.getExpiryTimeInMs():
                self.entry.update((seq, None, 0, True))
                return iter([Row(key=key[0], event="expire", value=value, at_ns=expire)])
        return iter([])

    def close(self) -> None:
        pass


def key_events(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Events of a streaming log. The watermark drives expiry; reads and CLEAR are not for it."""
    rows = log.where(F.col("op").isin("SET", "DELETE")).withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))).withWatermark("ts", delay)
    return rows.groupBy("key").transformWithState(KeyProcessor(), EVENT, "Append", "EventTime")


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last complete part under ``path`` (0: none), and the parts that make up the state."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0, []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = sorted((n for n in names if n[:4] in ("base", "part") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))), key=lambda n: (int(n[5:]), n))
    if not done:
        return 0, []
    bases = [int(n[5:]) for n in done if n.startswith("base")]
    since = max(bases, default=0)
    used = [n for n in done if n.startswith("base") and int(n[5:]) == since or n.startswith("part") and int(n[5:]) > since]
    return int(done[-1][5:]), [f"{path}/{n}" for n in used]


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The merged state (with tombstones) that ``upsert_batches`` keeps under ``path``; None before the first batch."""
    _, parts = _parts(spark, path)
    if not parts:
        return None
    rows = spark.read.parquet(*parts)
    return merged(rows, rows.where(F.lit(False)).withColumn("ts_ns", F.lit(0)).withColumn("ttl_ns", F.lit(0)))


def stored_entries(spark: SparkSession, path: str) -> DataFrame | None:
    """The entries among ``stored``."""
    rows = stored(spark, path)
    return None if rows is None else entries(rows)


def wait(query: StreamingQuery) -> None:
    """Barrier: what was written to the log before this is in the state afterwards."""
    query.processAllAvailable()


def upsert_batches(log: DataFrame, path: str, checkpoint: str, config: KeyspaceConfig = KeyspaceConfig(), compact_every: int = 16, keep: int | None = None):
    """Keep a state under ``path``, batch by batch.

    A batch writes one part with the last change of each key in it, deletions and
    CLEAR included, so its cost is the batch's and not the state's; every
    ``compact_every`` parts the state is written as a new base, and what came before
    the last base is removed. A part counts once it is complete. Changes apply by
    sequence number, so a SET that comes late stays dead, and a batch that is
    repeated, or a new checkpoint over the same path, changes nothing that is there.
    ``keep``: tombstones this far behind the newest row go at compaction.
    """
    spark = log.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        last, _ = _parts(spark, path)
        at = last + 1
        merged(None, batch, config).write.mode("overwrite").parquet(f"{path}/part-{at}")
        if at % compact_every == 0:
            rows = stored(spark, path)
            merged(rows, batch.where(F.lit(False)), config, keep).write.mode("overwrite").parquet(f"{path}/base-{at}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            for s in fs.listStatus(folder):
                # Readers of the base before may still be at it; what is older goes.
                if s.getPath().getName()[:4] in ("base", "part") and int(s.getPath().getName()[5:]) <= at - compact_every:
                    fs.delete(s.getPath(), True)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
