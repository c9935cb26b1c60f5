"""Shared pieces: batch mapping in Arrow, words, tables, durable cuts of lineage."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes and rows that a worker holds decoded at a time (one longer text goes alone).
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 1024
#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; bytes.split() cuts at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a local one only on a local master where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if at is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            import tempfile

            at = tempfile.mkdtemp(prefix="ks-checkpoint-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table in the shared folder and read it again."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if b is None else b for b in column.cast(kind).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``most`` bytes of text, or one row."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (held + n > most or i - at >= CHUNK_ROWS * max(1, most // CHUNK_BYTES)):
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def map_texts(df: DataFrame, text: str, out: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over bounded slices; ``make()`` runs once a task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in chunks(batches, text):
            yield f(b)

    return df.mapInArrow(run, out)


def with_results(df: DataFrame, id_col: str, out: T.StructType) -> T.StructType:
    """Schema of a per-row result: the identifier, then the results."""
    return T.StructType([T.StructField(id_col, df.schema[id_col].dataType, True), *out.fields])


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in kinds.items()])


def crc_fold(ids: pa.Array, mod: int) -> list[int]:
    """crc32 of the identifier's decimal text, modulo; a null identifier is the empty text."""
    return [zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids.to_pylist()]


def ragged(lists: list[list]) -> "tuple":
    """Offsets (int64, one more than lists) of concatenated lists."""
    import numpy as np

    return np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
