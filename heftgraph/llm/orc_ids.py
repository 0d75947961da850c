"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Files hold (doc_id, file_no, local_start, ids), sorted by doc_id within and across files, so stripes
can be read in parallel and a filter on doc_id skips files, stripes and row groups by their
statistics and Bloom filters. local_start counts the ids before a document within its file.

Results for odd input: null or empty texts hold only the end id; documents of equal doc_id lie side
by side, ordered by text; a null doc_id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.llm.common import broadcast_if_small, column, slices, texts, utf8
from heftgraph.llm.tokens import ids_of

SCHEMA = "doc_id long, file_no int, local_start long, ids array<int>"


def with_end(flat: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every sequence with end_id after it, and the new bounds."""
    n = len(bounds) - 1
    out = np.full(len(flat) + n, end_id, np.uint32)
    new = bounds + np.arange(n + 1)
    take = np.ones(len(out), bool)
    take[new[1:] - 1] = False
    out[take] = flat
    return out, new


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Range-partition the texts by doc_id, sort, encode and write; the ids themselves are never shuffled."""
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("file_no", F.spark_partition_id())

    def run(batches):
        encoder, start = ids_of(tokenizer), 0
        for batch in batches:
            for part in slices(batch, "text"):
                flat, bounds = with_end(*encoder.encode(*utf8(column(part, "text"))), end_id)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "file_no"), pa.array(start + bounds[:-1]), ids], names=["doc_id", "file_no", "local_start", "ids"])
                start += int(bounds[-1])

    # zstd over the runs; the filters and a row index every 1000 rows keep point reads small
    ordered.mapInArrow(run, SCHEMA).write.options(**{"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id are pushed down to stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""

    def run(batches):
        for batch in batches:
            ids = column(batch, "ids")
            offsets = ids.offsets.to_numpy().astype(np.int64)
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "file_no"), column(batch, "local_start"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "file_no", "local_start", "n_tokens", "ids_crc32"])

    stored = read_ids(spark, path)
    own = stored.groupBy("file_no").agg(F.max(F.col("local_start") + F.size("ids")).alias("n"))
    # one row a file; a running sum over files, not over documents
    before = own.selectExpr("file_no", "coalesce(sum(n) over (order by file_no rows between unbounded preceding and 1 preceding), 0) as base")
    rows = stored.mapInArrow(run, "doc_id long, file_no int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(broadcast_if_small(before), "file_no", "left").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
