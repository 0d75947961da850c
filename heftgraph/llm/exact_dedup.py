"""Exact dedup by a log-structured merge index over text digests.

Every task fills a memtable (digest to texts, counts and ids) and flushes it, when it holds enough
bytes, as a sorted run with a Bloom filter; a digest met again within a memtable is compared byte
for byte. Compaction goes by levels: FANOUT runs at a time become one run of the next level, until
one is left. There, a run's digests are held against the filters of the runs before it, and only
where a filter lets one through is it looked up in that run. A hit's entries become one, which keeps
the winning identifier and the summed count; the losing entry and its winner are written down for
verification. Runs of higher levels are cut by digest prefix, so that a task never holds more than
FANOUT memtables' digests, and no entry has more than FANOUT partners at a level.

Each losing entry's text is then compared with its winner's, byte for byte. A digest for which two
texts differ is taken out of the index and its rows are grouped by the texts themselves.

Results for odd input: null counts as the empty text, and empty texts are equal to each other; rows
of equal doc_id and text count each in group_size, and just one row with the winning doc_id is kept;
a null doc_id loses to any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import broadcast_if_small, column, give_back, settle, texts

#: Bytes of distinct texts that a memtable may hold before it is flushed.
MEMTABLE_BYTES = 24 << 20
#: Ids that a memtable may hold.
MEMTABLE_ROWS = 100_000
#: Runs that become one at a compaction.
FANOUT = 8
FILTER_HASHES = 5
#: An entry of a run, or, where filter is set, a run's filter.
ENTRY = "run string, variant int, digest binary, ids array<long>, best long, filter binary"
#: kind 0: an entry of the next level; 1: a losing entry (run, variant, best) with the one that won; 2: a filter.
MERGED = "kind int, at long, slice long, run string, variant int, digest binary, best long, n long, won_run string, won_variant int, won long, filter binary"
_MERGED = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("slice", pa.int64()), ("run", pa.string()), ("variant", pa.int32()), ("digest", pa.binary()), ("best", pa.int64()), ("n", pa.int64()), ("won_run", pa.string()), ("won_variant", pa.int32()), ("won", pa.int64()), ("filter", pa.binary())])


def _hashes(digests: pa.Array | list[bytes]) -> np.ndarray:
    """The 32 bytes of every digest as eight numbers."""
    raw = b"".join(digests.to_pylist() if isinstance(digests, (pa.Array, pa.ChunkedArray)) else digests)
    return np.frombuffer(raw, "<u4").reshape(-1, 8)


def bloom(hashes: np.ndarray, bits_per_key: int = 10) -> bytes:
    """Bloom filter over digests; their own bytes serve as hashes."""
    size = max(64, 1 << (len(hashes) * bits_per_key - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[hashes[:, :FILTER_HASHES].astype(np.int64) % size] = True
    return np.packbits(bits).tobytes()


def may_hold(run_filter: bytes, hashes: np.ndarray) -> np.ndarray:
    """For every digest, whether the run may hold it."""
    packed = np.frombuffer(run_filter, np.uint8)
    at = hashes[:, :FILTER_HASHES].astype(np.int64) % (8 * len(packed))
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


class Memtable:
    def __init__(self, prefer_largest: bool):
        self.pick = max if prefer_largest else min
        self.clear()

    def clear(self) -> None:
        self.entries: dict[bytes, list[tuple[str, list[int | None]]]] = {}
        self.bytes = self.rows = 0

    def add(self, doc_id: int | None, text: str) -> None:
        raw = text.encode()
        variants = self.entries.setdefault(hashlib.sha256(raw).digest(), [])
        for known, ids in variants:
            if known == text:  # the byte verification of a hit within the memtable
                ids.append(doc_id)
                break
        else:
            variants.append((text, [doc_id]))
            self.bytes += len(raw) + 200
        self.rows += 1

    def full(self) -> bool:
        return self.bytes >= MEMTABLE_BYTES or self.rows >= MEMTABLE_ROWS

    def flush(self, run: str) -> pa.RecordBatch:
        rows = []
        for digest in sorted(self.entries):
            for variant, (_, ids) in enumerate(self.entries[digest]):
                rows.append((run, variant, digest, ids, self.pick((i for i in ids if i is not None), default=None), None))
        rows.append((run, None, None, None, None, bloom(_hashes(list(self.entries)))))
        self.clear()
        cols = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["run", "variant", "digest", "ids", "best", "filter"])


def runs(docs: DataFrame, prefer_largest: bool) -> DataFrame:
    """ENTRY rows of all runs over docs (doc_id, text), and a filter a run; within a run they are sorted by digest."""

    def fill(batches):
        from pyspark import TaskContext

        table, k, part = Memtable(prefer_largest), 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                table.add(i, t)
                if table.full():
                    yield table.flush(f"{part}-{k}")
                    k += 1
            give_back()
        if table.rows:
            yield table.flush(f"{part}-{k}")
        give_back()

    return docs.mapInArrow(fill, ENTRY)


def merge_runs(entries: pa.Table, filters: pa.Table, prefer_largest: bool) -> pa.Table:
    """MERGED rows of one new run from the entries (at, slice, level_run, run, variant, digest, best, n) of some runs and their filters (level_run, filter)."""
    n = entries.num_rows
    if not n:
        return pa.Table.from_pylist([], schema=_MERGED)
    hashes = _hashes(entries["digest"])
    key = np.ascontiguousarray(hashes[:, :2]).view(">u8").ravel().astype(np.uint64)
    order = np.lexsort((key, entries["level_run"].to_numpy()))
    entries, hashes, key = entries.take(pa.array(order)).combine_chunks(), hashes[order], key[order]
    names, start = np.unique(entries["level_run"].to_numpy(), return_index=True)
    end = np.append(start[1:], n)
    held = dict(zip(filters["level_run"].to_pylist(), filters["filter"].to_pylist(), strict=True))
    head = np.arange(n)  # the entry of the same digest in the first run that has it
    for j in range(1, len(names)):
        own = np.arange(start[j], end[j])
        for i in range(j):
            maybe = own[may_hold(held[names[i]], hashes[own])]
            run = key[start[i] : end[i]]
            lo, hi = np.searchsorted(run, key[maybe], "left"), np.searchsorted(run, key[maybe], "right")
            for step in range(int((hi - lo).max(initial=0))):  # more than one where digests begin alike
                on = np.flatnonzero(lo + step < hi)
                at, to = start[i] + lo[on] + step, maybe[on]
                same = (hashes[at] == hashes[to]).all(axis=1) & (head[to] == to)
                head[to[same]] = head[at[same]]
    best = entries["best"].combine_chunks()
    null, value = np.asarray(best.is_null()), best.fill_null(0).to_numpy(zero_copy_only=False)
    rank = np.lexsort((~value if prefer_largest else value, null, head))
    first = np.ones(n, bool)
    first[1:] = head[rank[1:]] != head[rank[:-1]]
    winner = np.empty(n, np.int64)
    winner[rank] = rank[np.flatnonzero(first)][np.cumsum(first) - 1]
    total = np.bincount(head, weights=entries["n"].to_numpy(), minlength=n).astype(np.int64)[head]
    won, lost = np.flatnonzero(winner == np.arange(n)), np.flatnonzero(winner != np.arange(n))

    def rows(kind: int, at: np.ndarray) -> pa.Table:
        own, other = entries.take(pa.array(at)), entries.take(pa.array(winner[at]))
        cols = [pa.array(np.full(len(at), kind), pa.int32()), own["at"], own["slice"], own["run"], own["variant"], own["digest"], own["best"], pa.array(total[at]), other["run"], other["variant"], other["best"], pa.nulls(len(at), pa.binary())]
        return pa.Table.from_arrays(cols, schema=_MERGED)

    new = {"kind": 2, "at": entries["at"][0].as_py(), "slice": entries["slice"][0].as_py(), "filter": bloom(hashes[won])}
    return pa.concat_tables([rows(0, won), rows(1, lost), pa.Table.from_pylist([new], schema=_MERGED)])


def compact(entries: DataFrame, filters: DataFrame, prefer_largest: bool) -> tuple[DataFrame, DataFrame | None]:
    """All levels over entries (run, variant, digest, best, n) and filters (run, filter): the last run, and the losing entries with their winners."""

    def merge(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return merge_runs(a, b, prefer_largest)
        finally:
            give_back()

    level, left = 0, filters.count()
    now = entries.withColumn("level_run", F.xxhash64("run"))
    held = filters.select(F.xxhash64("run").alias("level_run"), "filter", F.lit(0).cast("long").alias("slice"))
    lost: DataFrame | None = None
    while left > 1:
        left = -(-left // FANOUT)
        # memtables' runs are dealt by hash, those of compactions are numbered
        at = F.floor(F.col("level_run") / FANOUT).cast("long") if level else F.pmod("level_run", F.lit(left))
        # FANOUT**level slices, by the first bits of the digest; a filter from below covers FANOUT of them
        prefix = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        own = now.withColumn("at", at).withColumn("slice", F.shiftright(prefix, 32 - 3 * min(level, 10)))
        fine = held.withColumn("at", at)
        if 0 < level <= 10:
            fine = fine.withColumn("slice", F.explode(F.sequence(F.col("slice") * FANOUT, F.col("slice") * FANOUT + FANOUT - 1)))
        both = own.groupBy("at", "slice").cogroup(fine.select("at", "slice", "level_run", "filter").groupBy("at", "slice"))
        merged = settle(both.applyInArrow(merge, MERGED), f"level{level + 1}")
        found = merged.filter("kind = 1").select("run", "variant", "digest", "best", "won_run", "won_variant", "won")
        lost = found if lost is None else lost.unionByName(found)
        now = merged.filter("kind = 0").select("run", "variant", "digest", "best", "n", F.col("at").alias("level_run"))
        held = merged.filter("kind = 2").select(F.col("at").alias("level_run"), "filter", "slice")
        level += 1
    return now, lost


def differing(lost: DataFrame, docs: DataFrame) -> DataFrame:
    """digest of the losing entries whose text is another than their winner's, compared byte for byte."""
    ids = settle(lost.select(F.explode(F.array("best", "won")).alias("id")).distinct(), "wanted")
    wanted = docs.join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # an entry's text is that of its winning id; of rows of equal id the digest tells which
    whole = settle(wanted.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sum")).dropDuplicates(["doc_id", "sum"]), "hit-texts")
    mine = whole.select(F.col("doc_id").alias("a"), F.col("sum").alias("sum_a"), F.col("text").alias("text_a"))
    other = whole.select(F.col("doc_id").alias("b"), F.col("sum").alias("sum_b"), F.col("text").alias("text_b"))
    seen = lost.join(mine, (F.col("digest") == F.col("sum_a")) & F.col("best").eqNullSafe(F.col("a")))
    seen = seen.join(other, (F.col("digest") == F.col("sum_b")) & F.col("won").eqNullSafe(F.col("b")))
    return seen.filter("text_a <> text_b").select("digest")


def by_text(docs: DataFrame, digests: DataFrame, prefer_largest: bool) -> DataFrame:
    """The result rows of texts whose digests collide, from the texts themselves."""
    rows = docs.withColumn("digest", F.unhex(F.sha2("text", 256))).join(digests, "digest", "left_semi")
    rows = settle(rows.withColumn("no", F.monotonically_increasing_id()), "collided")
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "no") if prefer_largest else F.struct(F.col("doc_id").isNull(), "doc_id", "no")
    best = (F.max if prefer_largest else F.min)(order)
    groups = rows.groupBy("text").agg(best.alias("best"), F.count("*").alias("group_size"))
    out = rows.join(groups, "text")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("no") == F.col("best.no")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, prefer_largest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for every row of docs.

    Of equal texts the smallest doc_id stays, or the largest.
    """
    named = texts(docs)
    stored = settle(runs(named, prefer_largest), "runs")
    entries = stored.filter("filter is null").select("run", "variant", "digest", "ids", "best")
    slim = entries.select("run", "variant", "digest", "best", F.size("ids").cast("long").alias("n"))
    last, lost = compact(slim, stored.filter("filter is not null").select("run", "filter"), prefer_largest)
    collided = entries.filter("variant > 0").select("digest")
    if lost is not None:
        lost = settle(lost, "lost")
        collided = collided.unionByName(differing(lost, named))
        hits = last.join(broadcast_if_small(settle(lost.select("digest").distinct(), "hits")), "digest", "left_semi")
        won = settle(hits.select("digest", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.col("run").alias("won_run")), "won")
        found = entries.join(broadcast_if_small(won), "digest", "left")
    else:
        found = entries.select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), F.lit(None).cast("string").alias("won_run"))
    collided = settle(collided.distinct(), "collided")
    hit = F.col("won_run").isNotNull()
    found = found.withColumn("keep_id", F.when(hit, F.col("keep_id")).otherwise(F.col("best"))).withColumn("group_size", F.when(hit, F.col("group_size")).otherwise(F.size("ids").cast("long")))
    place = F.when(F.col("keep_id").isNull(), 1).otherwise(F.array_position("ids", F.col("keep_id")))
    rows = found.select(F.posexplode("ids").alias("at", "doc_id"), "keep_id", "group_size", F.coalesce(F.col("won_run") == F.col("run"), F.lit(True)).alias("winner"), place.alias("first"), "digest")
    none_collide = collided.isEmpty()
    if not none_collide:
        rows = rows.join(collided, "digest", "left_anti")
    out = rows.select("doc_id", "keep_id", "group_size", (F.col("winner") & (F.col("at") + 1 == F.col("first"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return out if none_collide else out.unionByName(by_text(named, collided, prefer_largest))
