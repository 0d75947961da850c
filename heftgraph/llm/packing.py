"""Best-fit packing of documents into sequences, improved by a swap-based local search.

Documents longer than a sequence are cut; their first piece takes the remainder, all others are
full and lie alone. The other pieces are dealt by hash into groups of bounded size, each packed
best-fit in descending order; then pieces of underfull sequences are exchanged one for one or two
for one, or moved, whenever that raises the sum of squared fills, until no such change is left.
Sequences that stay underfull are taken apart and packed again in groups of their own.

Results for odd input: null or empty texts hold only the end id; documents of equal doc_id are
packed each, with pieces told apart by sequence_id and offset; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import column, settle, slices, texts, utf8
from heftgraph.llm.orc_ids import with_end
from heftgraph.llm.tokens import ids_of

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Pieces of one packing group: some 40 bytes each, however many documents there are.
GROUP = 2048
#: Rounds in which underfull sequences are packed again.
ROUNDS = 2
#: Sequences filled less than this are underfull.
LOOSE = 0.97


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """PIECES of every whole text."""

    def run(batches):
        encoder = ids_of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, bounds = with_end(*encoder.encode(*utf8(column(part, "text"))), end_id)
                size = np.diff(bounds)
                n = -(-size // length)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = size - (n - 1) * length
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
                long = np.where(piece == 0, first[row], length)
                at = bounds[row] + start
                view = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), long.tolist(), strict=True)]
                ids = column(part, "doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start), pa.array(long, pa.int32()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


def best_fit(sizes: Sequence[int], room: int) -> list[list[int]]:
    """Descending best fit: each item goes where the least room stays."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(room + 1)]
    held = 0  # bit r: some bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = held >> sizes[i]
        if fit:
            r = sizes[i] + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                held &= ~(1 << r)
        else:
            b, r = len(bins), room
            bins.append([])
        bins[b].append(i)
        free[r - sizes[i]].append(b)
        held |= 1 << (r - sizes[i])
    return bins


def _sets(sizes: Sequence[int], items: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(size, items) of one item or two of a bin, one for every size of the parts."""
    one = {sizes[i]: i for i in reversed(items)}
    many = Counter(sizes[i] for i in items)
    out = [(s, (i,)) for s, i in one.items()]
    known = sorted(one)
    for k, s in enumerate(known):
        if many[s] > 1:
            pair = [i for i in items if sizes[i] == s][:2]
            out.append((2 * s, tuple(pair)))
        out += [(s + t, (one[s], one[t])) for t in known[k + 1 :]]
    return out


def local_search(sizes: Sequence[int], bins: list[list[int]], room: int, loose: float = LOOSE) -> list[list[int]]:
    """Raise the sum of squared fills by changes between two bins until none is left that does; emptied bins go.

    A change between a giving bin b and a taking bin a moves d tokens from b to a, 0 < d <= the room
    in a: b gives one item or two outright, one for one, one for two, or two for one. It raises the
    sum by 2 d (fill of a - fill of b + d). Givers are the bins filled less than loose, emptiest first;
    every bin with room takes. Of all changes of a giver one that empties it comes first, then the one
    that raises the sum most. Every pass looks at all bins; passes end when one changes nothing.
    """
    bins = [list(b) for b in bins]
    fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    sets = [_sets(sizes, b) if f < room else [] for b, f in zip(bins, fill.tolist(), strict=True)]
    while True:
        # what the bins with room can give back: nothing, one item or two
        taker = np.flatnonzero((fill > 0) & (fill < room))
        if len(taker) < 2:
            break
        options = [(0, (), int(a)) for a in taker] + [(s, x, int(a)) for a in taker for s, x in sets[a]]
        back, owner, number = np.array([o[0] for o in options]), np.array([o[2] for o in options]), np.array([len(o[1]) for o in options])
        stale = np.zeros(len(bins), bool)
        changed = False
        for b in sorted(taker[fill[taker] < loose * room].tolist(), key=lambda b: (fill[b], b)):
            if stale[b]:
                continue
            gives = sets[b]
            given, count = np.array([g[0] for g in gives])[:, None], np.array([len(g[1]) for g in gives])[:, None]
            d = given - back
            gain = 2 * d * (fill[owner] - fill[b] + d)
            good = (d > 0) & (d <= room - fill[owner]) & (gain > 0) & (count + number <= 3) & (owner != b) & ~stale[owner]
            if not good.any():
                continue
            value = np.where(good, gain + (d == fill[b]) * (1 << 40), -1)
            y, x = np.unravel_index(int(value.argmax()), value.shape)
            give, (_, take, a) = gives[y][1], options[x]
            bins[b] = [i for i in bins[b] if i not in give] + list(take)
            bins[a] = [i for i in bins[a] if i not in take] + list(give)
            fill[a] += d[y, x]
            fill[b] -= d[y, x]
            for k in (a, b):
                sets[k], stale[k] = _sets(sizes, bins[k]) if fill[k] < room else [], True
            changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack_group(sizes: Sequence[int], room: int) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, room), room)


def _packer(k: int, last: bool, length: int, rounds: int):
    def run(table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table["length"].to_pylist()
        no = table["group"][0].as_py()
        seq, off = [0] * len(sizes), [0] * len(sizes)
        for b, items in enumerate(pack_group(sizes, length)):
            loose = not last and sum(sizes[i] for i in items) < length * LOOSE
            at = 0
            for i in items:
                seq[i] = -1 if loose else ((no << 24) + b) * (rounds + 2) + 1 + k
                off[i] = at
                at += sizes[i]
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    return run


def pack(pieces: DataFrame, length: int, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """PLACED rows of pieces: full ones alone, the others packed in groups."""
    full = pieces.filter(F.col("length") == length)
    done = [full.select("*", (F.monotonically_increasing_id() * (rounds + 2)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.filter(F.col("length") < length)
    for k in range(rounds + 1):
        n = rest.count()
        if not n:
            break
        groups = max(1, -(-n // group))
        last = k == rounds or groups == 1

        # dealt by the place of a row in its stored table, so that equal rows don't meet
        key = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), F.lit(groups)).alias("group")
        placed = settle(rest.select("*", key).groupBy("group").applyInArrow(_packer(k, last, length, rounds), PLACED), f"packed{k}")
        done.append(placed.filter("sequence_id >= 0"))
        rest = placed.filter("sequence_id < 0").drop("sequence_id", "offset")
        if last:
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    placed = pack(settle(cut_pieces(docs, tokenizer, end_id, length), "pieces"), length, group)
    return placed.withColumn("length", F.col("length").cast("long"))
