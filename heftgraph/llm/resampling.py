"""Importance resampling of documents toward a target corpus, without replacement.

Features of a text are its words and word pairs, hashed into buckets by crc32. The counts of buckets
over all documents and over the target give each bucket's log ratio, and a document's weight is the
mean over its features. A Gumbel variate made from the doc_id is added, so that the highest scores
are a draw without replacement in proportion to the weights.

The drawn rows get their ranks by an external merge: each partition of scored documents is sorted
and written as a run of chunks; tournament trees merge the runs, FANIN at a time, until one order is
left, whose rows get their ranks until the draw is complete. The merge is cut into ranges of about
RANGE rows by the exact counts of scores, so every range is merged by a task of its own and its ranks
begin where those of the ranges before end; ranges beyond the draw aren't merged. A task holds one chunk
of each run.

Results for odd input: a null or wordless text has no features and weight 0; null doc_ids take the
variate of the empty string and lose ties; rows of equal doc_id and score are ranked by the number of
features; rows that agree in all of these get ranks of their own; other columns aren't read; an empty
target or an empty table counts nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import column, forget, settle, slices, texts, utf8
from heftgraph.llm.words import word_spans

#: Rows of a range of scores that one task merges.
RANGE = 1 << 16
#: Runs that one tournament merges.
FANIN = 64
#: Rows of a chunk: 40 bytes each.
CHUNK = 4096
#: Bytes of a word that are hashed for all words at once; longer words go on by themselves.
TOGETHER = 24
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
CHUNKS = "part long, run long, k0 long, k1 long, k2 long, k3 long, rows binary"

_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_START = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 registers after data[start:end] of each span."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, TOGETHER + 1).astype(np.int16), kind="stable")
    s, at, left = state[order], starts[order], size[order]
    for j in range(min(TOGETHER, int(size.max(initial=0)))):
        m = int(np.searchsorted(-left, -j, side="left")) if j < TOGETHER else 0
        s[:m] = _CRC[(s[:m] ^ data[at[:m] + j]) & 255] ^ (s[:m] >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    for i in np.flatnonzero(size > TOGETHER):
        out[i] = zlib.crc32(data[starts[i] + TOGETHER : ends[i]].tobytes(), int(out[i] ^ _START)) ^ int(_START)
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every word and word pair, and the number of words of each text."""
    low = _LOWER[data]
    starts, ends, doc = word_spans(low, offsets, _WORD)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    if not len(starts):
        return np.zeros(0, np.int64), doc, n
    one = _crc_on(np.full(len(starts), _START), low, starts, ends)
    together = np.flatnonzero(doc[1:] == doc[:-1])
    space = _CRC[(one[together] ^ np.uint32(0x20)) & 255] ^ (one[together] >> np.uint32(8))
    two = _crc_on(space, low, starts[together + 1], ends[together + 1])
    return (np.concatenate([one, two]) ^ _START).astype(np.int64) % buckets, np.concatenate([doc, doc[together]]), n


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                held += np.bincount(features(*utf8(column(part, "text")), buckets)[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "c"])

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    out = np.zeros(buckets, np.int64)
    for bucket, c in text.mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c")).collect():
        out[bucket] = c
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over its share of the documents."""
    n = float(len(own))
    all_own, all_target = float(own.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * all_own / ((s + 1) * all_target))) for s, t in zip(own.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def variate(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) of the Gumbel variate of a doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                m = part.num_rows
                bucket, doc, n_words = features(*utf8(column(part, "text")), len(sent.value))
                n = np.bincount(doc, minlength=m)
                total = np.bincount(doc, sent.value[bucket], m).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = column(part, "doc_id")
                score = weight + np.array([variate(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n), pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return texts(docs).mapInArrow(run, SCORED)


class Ranges:
    """Ranges of rows in order of score (falling) and doc_id, from the exact counts of scores.

    counts are rows (score, count, least doc_id, greatest doc_id). Scores are whole thousandths of two
    logarithms of bounded numbers, so there are at most some hundred thousand, whatever the number of
    rows. A score of more than RANGE rows is cut into equal widths of doc_ids.
    """

    def __init__(self, counts: list, draw: int):
        first, parts, low, width, scores = [], [], [], [], []
        held, total, at = 0, 0, 0
        for score, c, lo, hi in sorted(counts, key=lambda r: -r[0]):
            if total >= draw:
                break
            cut = -(-c // RANGE)
            if held and (cut > 1 or held + c > RANGE):
                at, held = at + 1, 0
            scores.append(score)
            first.append(at)
            parts.append(cut)
            low.append(lo or 0)
            width.append(((hi or 0) - (lo or 0)) // cut + 1)
            if cut > 1:
                at += cut
            else:
                held += c
            total += c
        self.least = scores[-1] if scores else None
        self._scores = np.array(scores[::-1], np.int64)
        self._first, self._parts, self._low, self._width = (np.array(v[::-1], np.int64) for v in (first, parts, low, width))

    def of(self, score: np.ndarray, doc_id: np.ndarray, missing: np.ndarray) -> np.ndarray:
        p = np.searchsorted(self._scores, score)
        part = np.where(missing, self._parts[p] - 1, (doc_id - self._low[p]) // self._width[p])
        return self._first[p] + np.clip(part, 0, self._parts[p] - 1)


def _chunk(part: int, run: int, rows: np.ndarray) -> Iterator[tuple]:
    for i in range(0, len(rows), CHUNK):
        own = rows[i : i + CHUNK]
        yield (part, run, *own[0, :4].tolist(), own.tobytes())


def _chunk_batch(chunks: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunks, strict=True), kinds, strict=True)], names=["part", "run", "k0", "k1", "k2", "k3", "rows"])


def runs(eligible: DataFrame, ranges: Ranges) -> DataFrame:
    """Each partition of eligible rows as one sorted run, in chunks that no range shares.

    A row is (-score, doc_id is null, doc_id, n_features, weight), and sorts by these.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        own = TaskContext.get().partitionId()
        for batch in batches:
            score, n, weight = (column(batch, c).to_numpy() for c in ("score", "n_features", "weight"))
            missing = column(batch, "doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = column(batch, "doc_id").fill_null(0).to_numpy()
            rows = np.column_stack([-score, missing.astype(np.int64), ids, n, weight])
            part = ranges.of(score, ids, missing)
            bounds = np.flatnonzero(np.diff(part)) + 1
            chunks = [c for piece in np.split(np.arange(len(rows)), bounds) if len(piece) for c in _chunk(int(part[piece[0]]), own, rows[piece])]
            if chunks:
                yield _chunk_batch(chunks)

    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    return eligible.sortWithinPartitions(*order).mapInArrow(run, CHUNKS)


class Tournament:
    """A winner tree over the heads of runs; chunks of a run are added in their order."""

    def __init__(self, leaves: int):
        self._base = 1 << max(leaves - 1, 0).bit_length()
        self._tree: list = [None] * (2 * self._base)
        self._rest: list[deque] = [deque() for _ in range(self._base)]

    def _play(self, leaf: int) -> None:
        """Matches from a leaf to the root; None has lost."""
        tree, i = self._tree, (self._base + leaf) >> 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = b if a is None or b is not None and b < a else a
            i >>= 1

    def left(self) -> Iterator[tuple]:
        """What hasn't been popped, in any order."""
        for leaf, rest in enumerate(self._rest):
            if self._tree[self._base + leaf] is not None:
                yield self._tree[self._base + leaf][0]
            yield from rest

    def add(self, leaf: int, rows: Iterator[tuple]) -> None:
        self._rest[leaf].extend(rows)
        if self._tree[self._base + leaf] is None:
            self._advance(leaf)

    def _advance(self, leaf: int) -> None:
        rest = self._rest[leaf]
        self._tree[self._base + leaf] = (rest.popleft(), leaf) if rest else None
        self._play(leaf)

    def head(self) -> tuple | None:
        top = self._tree[1]
        return top and top[0]

    def pop(self) -> tuple:
        row, leaf = self._tree[1]
        self._advance(leaf)
        return row


def merged_rows(chunks: Iterator[tuple[tuple, int, bytes]], most: float = math.inf) -> Iterator[tuple]:
    """The first most rows of at most FANIN runs in order, then the others in any order, from their chunks (first row's key, run, rows) in order of the first row."""
    tree, left = Tournament(FANIN), most
    leaves: dict[int, int] = {}
    for first, run, data in chunks:
        while left > 0 and (head := tree.head()) is not None and head[:4] < first:
            yield tree.pop()
            left -= 1
        rows = map(tuple, np.frombuffer(data, np.int64).reshape(-1, 5).tolist())
        if left > 0:
            tree.add(leaves.setdefault(run, len(leaves)), rows)
        else:
            yield from rows
    while left > 0 and tree.head() is not None:
        yield tree.pop()
        left -= 1
    yield from tree.left()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator]]:
    """(part, group) and its chunks, from rows in order of these."""
    held: list = [None]

    def every():
        for batch in batches:
            for r in batch.to_pylist():
                yield (r["part"], r["grp"]), ((r["k0"], r["k1"], r["k2"], r["k3"]), r["run"], r["rows"])

    stream = every()

    def own(key):
        while held[0] is not None and held[0][0] == key:
            yield held[0][1]
            held[0] = next(stream, None)

    held[0] = next(stream, None)
    while held[0] is not None:
        key = held[0][0]
        yield key, own(key)


def _dealt(chunks: DataFrame) -> DataFrame:
    """Chunks with grp, the number of their FANIN runs; those of one range and group in one task, in order."""
    dealt = chunks.withColumn("grp", F.expr(f"run div {FANIN}")).repartition("part", "grp")
    return dealt.sortWithinPartitions("part", "grp", "k0", "k1", "k2", "k3")


def merge_runs(chunks: DataFrame) -> DataFrame:
    """Runs of each range and FANIN runs as one run."""

    def run(batches: Iterator[pa.RecordBatch]):
        for (part, group), own in _groups(batches):
            held = []
            for row in merged_rows(own):
                held.append(row)
                if len(held) == CHUNK:
                    yield _chunk_batch(list(_chunk(part, group, np.array(held, np.int64))))
                    held = []
            if held:
                yield _chunk_batch(list(_chunk(part, group, np.array(held, np.int64))))

    return _dealt(chunks).mapInArrow(run, CHUNKS)


def _ranked_batch(rows: list[tuple], start: int, draw: int) -> pa.RecordBatch:
    m = np.array(rows, np.int64)
    rank = np.arange(start, start + len(m)) + 1
    arrays = [pa.array(m[:, 2], mask=m[:, 1] > 0), pa.array(m[:, 3]), pa.array(m[:, 4]), pa.array(-m[:, 0]), pa.array(rank, mask=rank > draw)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_features", "weight", "score", "rank"])


def ranks(chunks: DataFrame, before: dict[int, int], draw: int) -> DataFrame:
    """The rows of all ranges with their ranks; once the draw is complete, the merge stops and rows go through without a rank."""
    sent = chunks.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]):
        for (part, _), own in _groups(batches):
            at = sent.value[part]
            held: list = []
            for row in merged_rows(own, draw - at):
                held.append(row)
                if len(held) == CHUNK:
                    yield _ranked_batch(held, at, draw)
                    at, held = at + CHUNK, []
            if held:
                yield _ranked_batch(held, at, draw)

    return _dealt(chunks).mapInArrow(run, "doc_id long, n_features long, weight long, score long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = 10_000, seed: int = 7, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; of the N rows with enough words, the percent * N / 100 highest scores have a rank."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    every = settle(scored(docs, gain, seed), "scored")
    enough = F.col("n_words") >= least_words
    counts = [tuple(r) for r in every.filter(enough).groupBy("score").agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).collect()]
    draw = percent * sum(r[1] for r in counts) // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return every.select(*out, undrawn)
    ranges = Ranges(counts, draw)
    near = enough & (F.col("score") >= ranges.least)
    chunks = settle(runs(every.filter(near), ranges), "runs")
    while chunks.agg(F.max("run")).first()[0] >= FANIN:
        fewer = settle(merge_runs(chunks), "runs")
        forget(chunks)
        chunks = fewer
    sizes = {r[0]: r[1] for r in chunks.groupBy("part").agg(F.sum(F.expr("length(rows) div 40"))).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    return ranks(chunks, before, draw).unionByName(every.filter(~near).select(*out, undrawn))
