"""Exact top-k by inner product of integer vectors with MaxScore.

A vector's components are the postings of as many terms. For a block of vectors, a query's term t
adds between low_t and high_t (its weight times the block's least and greatest posting), so
low-shifted contributions are non-negative and high_t - low_t bounds them. Terms are sorted by that
bound; the longest run of small ones whose bounds sum to less than what the k-th best result so far
asks for is non-essential. Essential postings are traversed for all vectors of the block, the
others only probed for vectors that can still compete. Each shard keeps its own k best a query; the
shards' results are merged. Queries are rows of blocks of bounded size, and so are the vectors of a
shard; every block meets every shard in some task, so nothing goes through the driver.

Results for odd input: vectors that are null or hold null, NaN or infinite components take no part,
neither as query nor as candidate; missing components of a shorter vector count 0; a zero-length
vector scores 0; rows of equal vec_id are queries and candidates each, and a query's own row alone is
not a candidate (its results stand under the same query_id as those of its twin, told apart by
query_row); an empty table gives an empty result. Scores are exact in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heftgraph.llm.common import column, settle

#: Queries of a block: 4096 x 64 components are 2 MB.
QUERY_BLOCK = 4096
#: Vectors that are scored together, and that a stored row of a shard holds.
VECTOR_BLOCK = 2048
#: Blocks of queries that are sent to all tasks at once; with more, blocks and shards are dealt out in pairs.
SENT_BLOCKS = 8
FOUND = "query_row long, query_id long, row long, vec_id long, score long"
BLOCK = "rows binary, ids binary, width int, components binary"


def quantized(vectors: DataFrame, *more) -> DataFrame:
    """vec_id, components floor(256 x) as longs, and more columns; rows that take no part are left out."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *more).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).withColumn("v", F.transform(e, lambda x: F.floor(x * 256)).cast("array<long>")).drop("embedding")


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class Shard:
    """The k best of each query over the blocks of one shard."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
        self.rows, self.ids, self.q, self.k = rows, ids, queries, k
        none = np.zeros(0, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none) for _ in rows]

    def add(self, rows: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        width = max(self.q.shape[1], block.shape[1])
        block = np.pad(block, ((0, 0), (0, width - block.shape[1])))
        q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1])))
        reach = float(np.abs(q).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(width, 1)
        if reach < 2**53:  # exact in doubles, and so much faster
            block, q = block.astype(np.float64), q.astype(np.float64)
        postings = np.ascontiguousarray(block.T)
        least, greatest = postings.min(axis=1, initial=0), postings.max(axis=1, initial=0)
        for i in range(len(self.rows)):
            self._one(i, q[i], rows, ids, postings, least, greatest)

    def _one(self, i: int, w: np.ndarray, rows: np.ndarray, ids: np.ndarray, postings: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> None:
        low, high = np.minimum(w * least, w * greatest), np.maximum(w * least, w * greatest)
        bound = high - low
        had, have, score = self.best[i]
        need = score[-1] - low.sum() if len(have) == self.k else None  # asked of a shifted score
        order = np.argsort(bound, kind="stable")
        reach = np.cumsum(bound[order])
        split = 0 if need is None else int(np.searchsorted(reach, need, side="left"))
        essential, other = order[split:], order[:split]
        part = w[essential] @ postings[essential] - low[essential].sum()
        live = np.arange(len(ids))
        while len(other):
            left = reach[len(other) - 1]
            keep = part + left >= need
            live, part = live[keep], part[keep]
            if not len(live):
                return
            probe, other = other[-8:], other[:-8]
            part = part + w[probe] @ postings[np.ix_(probe, live)] - low[probe].sum()
        total = np.rint(part + low.sum()).astype(np.int64) if part.dtype == np.float64 else part + low.sum()
        keep = rows[live] != self.rows[i]
        if need is not None:
            keep &= total >= score[-1]
        rows, ids, total = np.concatenate([had, rows[live][keep]]), np.concatenate([have, ids[live][keep]]), np.concatenate([score, total[keep]])
        if len(ids) > 64:  # the k-th best and its ties, before the full sort
            edge = np.partition(total, len(total) - self.k)[len(total) - self.k]
            rows, ids, total = rows[total >= edge], ids[total >= edge], total[total >= edge]
        first = np.lexsort((rows, ids, -total))[: self.k]
        self.best[i] = (rows[first], ids[first], total[first])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """BLOCK rows of at most size vectors each from (row, vec_id, v), packed within the partitions."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = column(part, "v").to_pylist()
                m = _matrix(lists, max(map(len, lists), default=0))
                yield pa.RecordBatch.from_pydict({"rows": [column(part, "row").to_numpy().tobytes()], "ids": [column(part, "vec_id").to_numpy().tobytes()], "width": pa.array([m.shape[1]], pa.int32()), "components": [m.tobytes()]})

    return rows.mapInArrow(run, BLOCK)


def _unpacked(rows: bytes, ids: bytes, width: int, components: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(rows, np.int64)
    return own, np.frombuffer(ids, np.int64), np.frombuffer(components, np.int64).reshape(len(own), width)


def top_k(vectors: DataFrame, is_query: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, query_row of the k best of every row of vectors(vec_id, embedding) for which is_query holds."""
    stored = settle(quantized(vectors, F.expr(is_query).alias("is_query")).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v", "is_query"), "vectors")
    shards = _blocks(stored.select("row", "vec_id", "v"), VECTOR_BLOCK)
    # whole blocks, so that they are few: as many partitions as queries fill
    asked = stored.filter("is_query").select("row", "vec_id", "v")
    many = -(-asked.count() // QUERY_BLOCK)
    queries = settle(_blocks(asked.repartition(max(many, 1), "row"), QUERY_BLOCK), "queries")
    queries = queries.select(F.monotonically_increasing_id().alias("block"), *(F.col(c).alias("q_" + c) for c in queries.columns))

    def run(batches):
        # a task's pairs come by shard; the shards so far give a block's queries their thresholds
        held: dict[int, Shard] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] not in held:
                    held[r["block"]] = Shard(*_unpacked(r["q_rows"], r["q_ids"], r["q_width"], r["q_components"]), k)
                held[r["block"]].add(*_unpacked(r["rows"], r["ids"], r["width"], r["components"]))
        for shard in held.values():
            n = [len(b[0]) for b in shard.best]
            if sum(n):
                cols = [np.repeat(shard.rows, n), np.repeat(shard.ids, n), *(np.concatenate([b[c] for b in shard.best]) for c in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_row", "query_id", "row", "vec_id", "score"])

    # blocks of rows, not rows, are paired: each block of queries is held against each shard
    found = shards.crossJoin(F.broadcast(queries) if many <= SENT_BLOCKS else queries).mapInArrow(run, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
