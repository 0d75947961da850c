"""Shared plumbing: scratch tables, guarded broadcasts, text slices."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id, flag) that may be broadcast after they have been counted: 16 bytes each, so 16 MB.
BROADCAST_ROWS = 1_000_000

#: Bytes of a batch of texts on its way to a Python worker. A batch of 10,000 long texts would be held several times over, outside the heap.
BATCH_BYTES = 8 << 20

_own_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a folder of our own in local mode (tests), an error on a cluster."""
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="heftgraph-")
    return _own_scratch


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the files of settled tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done, on all executors: it does so when the driver's references to them are collected."""
    gc.collect()
    spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted and small, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_ROWS * 16) -> DataFrame:
    """df with a broadcast hint if its rows, of so many bytes each, are counted and stay within most bytes."""
    return broadcast_if_small(df, most // row_bytes)


def free_name(name: str, taken: list[str]) -> str:
    """name, lengthened until no column has it (in any case)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches of this session by bytes too, unless it sets a bound itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long, text with null as empty, and the extra columns; all others are left unread."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the n + 1 offsets into them; no copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_libc = None


def give_back() -> None:
    """Return what this worker has freed to the system: workers are reused, and keep it otherwise."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        name = ctypes.util.find_library("c")
        _libc = ctypes.CDLL(name) if name else False
    if _libc and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, *more: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most limit text bytes over these columns (or of one row), so that work arrays stay bounded."""
    offsets = sum(utf8(batch.column(batch.schema.get_field_index(c)))[1] for c in (column, *more))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
