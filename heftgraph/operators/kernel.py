"""Sweeps over a build that fits a stated bound: dense ids, one compact copy a task, one cut after the other.

The build is sent once, as numbers and Arrow strings; what a policy says of its modules is two flags a
module, sent apart, so another policy sends only these. A sweep follows the frontier with array
operations; its results are sums where sums are asked for, and rows only where rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges, nodes and characters of names that may be sent to all tasks, counted before: some 100 MB at most.
EDGES, NODES, CHARS = 1_000_000, 1_000_000, 48_000_000
#: Sets whose members fit the bits of one long.
WORD = 64


class Sweeper:
    """Names, modules and sizes of nodes, and edges by source."""

    def __init__(self, names: list[str], modules: list[str], size: np.ndarray, roots: list[str], src: list[str], dst: list[str]):
        self.names = pa.array(names, pa.large_string())
        at = pd.Index(names)
        self.module_names, module = np.unique(np.array(modules, dtype=object), return_inverse=True)
        self.module, self.size = module.astype(np.int32), size
        s, d = at.get_indexer(src), at.get_indexer(dst)
        order = np.argsort(s, kind="stable")
        self.src, self.dst = s[order].astype(np.int32), d[order].astype(np.int32)
        self.first = np.searchsorted(self.src, np.arange(len(names) + 1))
        self.roots = at.get_indexer(roots)
        self.base = self.sweep(self.roots)

    def ids(self, names: list[str]) -> np.ndarray:
        at = pd.Index(self.names.to_pylist()).get_indexer(names)
        return at[at >= 0]

    def modules(self, names: list[str]) -> np.ndarray:
        """Numbers of these modules, -1 for those that no node has."""
        return pd.Index(self.module_names).get_indexer(names)

    def label(self, kind: str, flags: np.ndarray) -> np.ndarray:
        """The module whose cut severs each edge, else -1; flags (2 x modules): which are controlled, which are targets."""
        sm, dm = self.module[self.src], self.module[self.dst]
        severed = flags[0][sm] & flags[1][dm] if kind == "cut" else sm != dm
        return np.where(severed, dm, np.int32(-1))

    def sweep(self, starts: np.ndarray, open_: np.ndarray | None = None) -> np.ndarray:
        """Which nodes are reached from starts along the open edges."""
        seen = np.zeros(len(self.size), bool)
        self.spread(np.unique(starts), seen, open_)
        return seen

    def spread(self, now: np.ndarray, seen: np.ndarray, open_: np.ndarray | None) -> int:
        """Mark now and all that it reaches as seen; the bytes of what is new."""
        bytes_ = 0
        now = now[~seen[now]]
        while len(now):
            seen[now] = True
            bytes_ += int(self.size[now].sum())
            lo = self.first[now]
            n = self.first[now + 1] - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            if open_ is not None:
                at = at[open_[at]]
            to = self.dst[at]
            now = np.unique(to[~seen[to]])
        return bytes_

    def without(self, label: np.ndarray, targets: list[str]) -> np.ndarray | None:
        """Which edges stay open when these targets are cut."""
        gone = self.modules(targets) if len(targets) else np.zeros(0, np.int64)
        gone = gone[gone >= 0]
        return ~np.isin(label, gone) if len(gone) else None

    def gains(self, label: np.ndarray, order: list[str]) -> list[int]:
        """What each target of an order frees beyond those before it.

        Walked backwards, from all of them cut: a target that is let in again only adds to what is
        reached, so a whole order costs one sweep.
        """
        number = self.modules(order)
        open_ = ~np.isin(label, number[number >= 0])
        seen = self.sweep(self.roots, open_)
        out = [0] * len(order)
        by = np.argsort(label, kind="stable")
        lo, hi = (np.searchsorted(label[by], number, side) for side in ("left", "right"))
        for k in range(len(order) - 1, -1, -1):
            if number[k] >= 0:
                own = by[lo[k] : hi[k]]
                open_[own] = True
                out[k] = self.spread(np.unique(self.dst[own[seen[self.src[own]]]]), seen, open_)
        return out

    def closures(self, targets: list[str]) -> np.ndarray:
        """For every node, as bits, which of at most WORD targets reach it."""
        bits = np.zeros(len(self.size), np.uint64)
        for k, m in enumerate(self.modules(targets).tolist()):
            if m >= 0:
                bits[self.module == m] |= np.uint64(1 << k)
        if not len(self.dst):
            return bits
        by = np.argsort(self.dst, kind="stable")
        src, to = self.src[by], self.dst[by]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        to = to[first]
        while True:
            new = bits[to] | np.bitwise_or.reduceat(bits[src], first)
            if np.array_equal(new, bits[to]):
                return bits
            bits[to] = new

    def rows(self, which: np.ndarray, cut_id: str) -> pa.RecordBatch:
        at = np.flatnonzero(which)
        return pa.RecordBatch.from_arrays([pa.array([cut_id] * len(at), pa.string()), self.names.take(pa.array(at)).cast(pa.string()), pa.array(self.module_names[self.module[at]].tolist(), pa.string()), pa.array(self.size[at], pa.int64())], names=["cut_id", "pkg", "module", "size"])


def build(nodes: DataFrame, links: DataFrame, roots: DataFrame) -> Sweeper | None:
    """The sweeper of stored nodes(pkg, module, size) and links(src, dst), or None where they are beyond the bounds."""
    if links.count() > EDGES:
        return None
    held = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("pkg")), F.lit(0)).alias("chars")).first()
    if held["n"] > NODES or held["chars"] > CHARS:
        return None
    n, h = nodes.select("pkg", "module", "size").orderBy("pkg").toArrow(), links.select("src", "dst").toArrow()
    own = [r["pkg"] for r in roots.select("pkg").distinct().collect()]
    return Sweeper(n["pkg"].to_pylist(), n["module"].to_pylist(), n["size"].to_numpy().astype(np.int64), own, h["src"].to_pylist(), h["dst"].to_pylist())


class Kernel:
    """A sweeper that tasks share, under one policy."""

    def __init__(self, sweeper: Sweeper, sent, classes: DataFrame):
        """sent: the broadcast sweeper; classes: module, controlled, target of all its modules but ''."""
        held = classes.select("module", "controlled", "target").toArrow()
        flags = np.zeros((2, len(sweeper.module_names)), bool)
        at = sweeper.modules(held["module"].to_pylist())
        for row, name in enumerate(("controlled", "target")):
            flags[row, at[at >= 0]] = np.array(held[name].to_pylist(), bool)[at >= 0]
        self.sent, self.flags = sent, flags

    def _cuts(self, cuts: DataFrame, kind: str, columns: list[str], of, schema: str) -> DataFrame:
        """of(sweeper, open edges, row) for every row of cuts(cut_id, targets, ...)."""
        sent, flags = self.sent, self.flags

        def run(batches: Iterator[pa.RecordBatch]):
            s, label = sent.value, None
            for batch in batches:
                label = s.label(kind, flags) if label is None else label
                for r in batch.to_pylist():
                    yield of(s, s.without(label, r["targets"] or []), r)

        return cuts.select(*columns).mapInArrow(run, schema)

    def freed(self, cuts: DataFrame, kind: str = "cut") -> DataFrame:
        """cut_id, bytes, packages that leave in each of cuts(cut_id, targets)."""

        def of(s: Sweeper, open_, r):
            gone = s.base & ~s.sweep(s.roots, open_)
            return pa.RecordBatch.from_arrays([pa.array([r["cut_id"]], pa.string()), pa.array([int(s.size[gone].sum())], pa.int64()), pa.array([int(gone.sum())], pa.int64())], names=["cut_id", "bytes", "packages"])

        return self._cuts(cuts, kind, ["cut_id", "targets"], of, "cut_id string, bytes long, packages long")

    def leaving(self, cuts: DataFrame, kind: str = "cut") -> DataFrame:
        """cut_id, pkg, module, size of what leaves in each of cuts(cut_id, targets)."""
        of = lambda s, open_, r: s.rows(s.base & ~s.sweep(s.roots, open_), r["cut_id"])
        return self._cuts(cuts, kind, ["cut_id", "targets"], of, "cut_id string, pkg string, module string, size long")

    def reached(self, cuts: DataFrame) -> DataFrame:
        """cut_id, pkg, module, size of what is reached in each of cuts(cut_id, targets, starts); null starts are the roots."""
        of = lambda s, open_, r: s.rows(s.sweep(s.roots if r["starts"] is None else s.ids(r["starts"]), open_), r["cut_id"])
        return self._cuts(cuts, "cut", ["cut_id", "targets", "starts"], of, "cut_id string, pkg string, module string, size long")

    def along(self, orders: DataFrame) -> DataFrame:
        """module, gain summed over orders(sample, targets): what each target frees beyond those before it, in whole bytes."""
        sent, flags = self.sent, self.flags

        def run(batches: Iterator[pa.RecordBatch]):
            s, label, gain = sent.value, None, {}
            for batch in batches:
                label = s.label("cut", flags) if label is None else label
                for r in batch.to_pylist():
                    for name, d in zip(r["targets"], s.gains(label, r["targets"]), strict=True):
                        gain[name] = gain.get(name, 0) + d
            if gain:
                yield pa.RecordBatch.from_arrays([pa.array(list(gain), pa.string()), pa.array(list(gain.values()), pa.int64())], names=["module", "gain"])

        return orders.select("sample", "targets").mapInArrow(run, "module string, gain long").groupBy("module").agg(F.sum("gain").alias("gain"))

    def closures(self, words: DataFrame) -> DataFrame:
        """pkg, word, bits: which targets of each of words(word, targets in order, WORD at most) reach a package."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]):
            s = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    bits = s.closures(r["targets"])
                    at = np.flatnonzero(bits)
                    yield pa.RecordBatch.from_arrays([s.names.take(pa.array(at)).cast(pa.string()), pa.array(np.full(len(at), r["word"], np.int32)), pa.array(bits[at].view(np.int64))], names=["pkg", "word", "bits"])

        return words.select("word", "targets").mapInArrow(run, "pkg string, word int, bits long")
