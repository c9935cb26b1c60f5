import pytest
from pyspark.sql import functions as F

from keystrata.sources.log import LOG
from keystrata.streaming.expiry import key_events, stored_entries, upsert_batches

S = 1_000_000_000


def test_expiry_events(spark, tmp_path):
    src = tmp_path / "in"
    batches = [
        [(1, 1 * S, "SET", "a", 1.0, 1, 5 * S), (2, 2 * S, "SET", "b", 2.0, 1, 0), (3, 3 * S, "SET", "c", 3.0, 1, 2 * S)],
        [(4, 4 * S, "SET", "c", 4.0, 1, 60 * S), (5, 4 * S, "DELETE", "b", None, 1, 0)],
        [(6, 30 * S, "SET", "d", 6.0, 1, 0)],
        [(7, 31 * S, "SET", "e", 7.0, 1, 0)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, LOG).coalesce(1).write.parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src / "*"))
    q = key_events(stream).writeStream.format("memory").queryName("key_events_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {(r.key, r.event, r.value) for r in spark.table("key_events_out").collect()}
    finally:
        q.stop()
    assert {("a", "set", 1.0), ("b", "set", 2.0), ("b", "delete", 2.0), ("d", "set", 6.0), ("e", "set", 7.0)} <= got
    assert ("a", "expire", 1.0) in got
    assert ("c", "overwrite", 4.0) in got and ("c", "expire", 3.0) not in got and ("c", "expire", 4.0) not in got


def _run(spark, src, path, checkpoint, **options):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = upsert_batches(stream, str(path), str(checkpoint), **options).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_upsert_batches(spark, tmp_path):
    src, path = tmp_path / "in", tmp_path / "state"
    batches = [
        [(1, S, "SET", "a", 1.0, 1, 0), (2, S, "SET", "b", 2.0, 1, 0)],
        [(5, S, "DELETE", "a", None, 1, 0), (4, S, "SET", "b", 9.0, 1, 0)],
        [(3, S, "SET", "a", 3.0, 1, 0), (6, S, "SET", "c", 6.0, 1, 0)],  # a's SET comes after its later DELETE
        [(9, S, "CLEAR", "", None, 1, 0), (8, S, "SET", "d", 8.0, 1, 0), (10, S, "SET", "e", 10.0, 1, 0)],
        [(7, S, "SET", "f", 7.0, 1, 0), (11, S, "SET", "g", 11.0, 1, 0)],  # f's comes after the CLEAR
    ]
    wanted = [{("a", 1.0), ("b", 2.0)}, {("b", 9.0)}, {("b", 9.0), ("c", 6.0)}, {("e", 10.0)}, {("e", 10.0), ("g", 11.0)}]
    for i, (b, want) in enumerate(zip(batches, wanted)):
        spark.createDataFrame(b, LOG).coalesce(1).write.parquet(str(src / f"b{i}"))
        _run(spark, src, path, tmp_path / "cp", compact_every=2)
        assert {(r.key, r.value) for r in stored_entries(spark, str(path)).collect()} == want
    # All of it again, under a new checkpoint, changes nothing; old parts are gone.
    _run(spark, src, path, tmp_path / "cp2", compact_every=2)
    assert {(r.key, r.value) for r in stored_entries(spark, str(path)).collect()} == wanted[-1]
    assert len(list(path.iterdir())) <= 5
