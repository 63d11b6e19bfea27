"""Helpers that the corpus operators share: tables, checkpoints, bounded broadcasts, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship

#: A side is broadcast only if it was counted and has at most this many rows (each of bounded width).
BROADCAST_ROWS = 50_000
#: Texts are handled in Python in slices of about so many bytes (a longer text makes its own slice).
SLICE_BYTES = 1 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers; and Arrow batches of 1000 texts in place of 10,000, unless the session
    says otherwise: they are held outside the heap, several at a time in each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local folder only on a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of keep() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most `rows` rows; else leaves the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_bound(share: float) -> int:
    """The bound of  hash <= bound  that the least `share` of all signed 64-bit hashes keep."""
    return min(int(share * 2**64), 2**64 - 1) - 2**63


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text is divisible by 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trimmed(run, tokens: bool = False):
    """run over a partition's batches; then what it has freed goes back to the system, as idle Python workers
    stay beside the next stage's, and words that a tokenizer remembers go first. With `tokens`, both stay."""

    def whole(batches):
        if not tokens and (own := sys.modules.get(f"{__package__}.tokens")):
            own.forget()
        yield from run(batches)
        if not tokens and sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the strings of `column` in each slice have about `limit` bytes at most."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def strings(column) -> pa.Array:
    """A string array without nulls (null: empty) whose buffers start at its first row."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.string())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and the offsets of each."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[: len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
