"""Cuts told from the entries that they leave open, where a policy has few of them.

An entry is a package that a cut may sever, with its target. A walk of the graph without the edges into
entries gives, for every package, the entries that reach it, as bits; packages alike in them go
together. Which entries a cut leaves open follows from the entries alone, and what it frees are the
packages that none of these reaches: however many cuts are asked for, the graph is walked once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.operators.kernel import WORD
from heftgraph.operators.reach import reach_bits
from heftgraph.operators.storage import stored

#: Entries that a walk may tell apart, counted before: so many bits a package, and squared in the driver.
MOST_ENTRIES = 1024


@dataclass
class Entries:
    """packages(pkg, module, size, open) with the entries that reach a package, as an array of words; entry 0 are the roots."""

    packages: DataFrame
    #: Target of every entry (None: the roots), and the entries from which each is reached.
    targets: list[str | None]
    feeds: np.ndarray

    def masks(self, cuts: DataFrame) -> DataFrame:
        """cut_id, mask of cuts(cut_id, targets): the entries that stay reached, as an array of words."""
        targets, feeds = np.array(self.targets, dtype=object), self.feeds

        def run(batches):
            bit = np.left_shift(np.uint64(1), np.arange(len(targets), dtype=np.uint64) % np.uint64(WORD))
            word = np.arange(len(targets)) // WORD
            for batch in batches:
                out = []
                for names in batch.column("targets").to_pylist():
                    gone = set(names or ()) - {None}
                    kept = np.array([k == 0 or t not in gone for k, t in enumerate(targets)])
                    mask, reached = np.zeros(feeds.shape[1], np.uint64), np.arange(len(targets)) == 0
                    while True:
                        np.bitwise_or.at(mask, word[reached], bit[reached])
                        more = kept & ~reached & (feeds & mask).any(axis=1)
                        if not more.any():
                            break
                        reached |= more
                    out.append(mask.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([batch.column("cut_id"), pa.array(out, pa.list_(pa.int64()))], names=["cut_id", "mask"])

        return cuts.select("cut_id", "targets").mapInArrow(run, "cut_id string, mask array<long>")

    def _masks(self, cuts: DataFrame) -> tuple[DataFrame, str]:
        """masks() of cuts, stored, and the condition that a mask leaves none of a package's entries open."""
        masks = stored(self.masks(cuts).withColumn("cut_id", F.col("cut_id").cast("string")))
        return masks, " and ".join(f"(open[{w}] & mask[{w}]) = 0" for w in range(self.feeds.shape[1]))

    def leaving(self, cuts: DataFrame) -> DataFrame:
        """cut_id, pkg, module, size of what leaves in each of cuts(cut_id, targets)."""
        masks, none = self._masks(cuts)
        return self.packages.join(F.broadcast(masks), F.expr(none)).select("cut_id", "pkg", "module", "size")

    def freed(self, cuts: DataFrame, *by) -> DataFrame:
        """cut_id, *by, bytes, packages that leave in each of cuts(cut_id, targets); by: columns over packages."""
        alike = stored(self.packages.groupBy(*by, "open").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        masks, none = self._masks(cuts)
        names = [c for c in alike.columns if c not in ("open", "size", "n")]
        # every cut against every set of entries; cuts that leave the same ones open go together
        same = masks.groupBy("mask").agg(F.min("cut_id").alias("first"))
        gone = alike.join(F.broadcast(same), F.expr(none)).groupBy("first", *names).agg(F.sum("size").alias("bytes"), F.sum("n").alias("packages"))
        return masks.join(same, "mask").join(gone, "first").select("cut_id", *names, "bytes", "packages")


def entries(hops: DataFrame, base: DataFrame, roots: DataFrame, numbered: DataFrame, most: int = MOST_ENTRIES) -> Entries | None:
    """The entries of hops(s, d, hub, cut_target) with what they reach of base(pkg, module, size), None where there are more than most; roots(node), numbered(pkg, id)."""
    spark = roots.sparkSession
    # an entry that only what isn't reachable imports stays closed, as no other one feeds it
    cut = stored(hops.filter("cut_target is not null").select("s", "d", "cut_target"))
    found = cut.select("d", "cut_target").distinct().limit(most).collect()
    if len(found) >= most:
        return None
    found.sort(key=lambda r: (r["cut_target"], r["d"]))
    placed = [(r["d"], r["cut_target"], k // WORD, int(np.uint64(1 << k % WORD).astype(np.int64))) for k, r in enumerate(found, 1)]
    own = spark.createDataFrame(placed, "node long, cut_target string, word int, bits long")
    starts = own.select("node", "word", "bits").unionByName(roots.select("node", F.lit(0).alias("word"), F.lit(1).cast("long").alias("bits")))
    bits = stored(reach_bits(hops.filter("cut_target is null").select(F.col("s").alias("src"), F.col("d").alias("dst"), "hub"), starts))
    words = len(found) // WORD + 1
    feeds = np.zeros((len(found) + 1, words), np.uint64)
    at = {(r["d"], r["cut_target"]): k for k, r in enumerate(found, 1)}
    into = cut.join(bits, cut["s"] == bits["node"]).groupBy("d", "cut_target", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    for r in into.collect():  # at most MOST_ENTRIES squared bits
        feeds[at[r["d"], r["cut_target"]], r["word"]] = np.int64(r["bits"]).astype(np.uint64)
    held = bits.groupBy(F.col("node").alias("id")).agg(F.array(*(F.coalesce(F.sum(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")) for w in range(words))).alias("open"))
    named = numbered.select("pkg", "id").join(held, "id")
    return Entries(stored(base.join(named, "pkg").select("pkg", "module", "size", "open")), [None, *(r["cut_target"] for r in found)], feeds)
