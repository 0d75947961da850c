"""Reachability under edge cuts by frontier joins, for many cuts at once and graphs of any size.

The cuts are bits, WORD of them a word: a row says in which cuts of a word a node is reached, so an
edge is followed once for all of them. Every round's new bits are written as a partition of their own;
what has been reached is never written twice. Nodes are numbers, odd ones hubs, from which many edges
start: theirs are stored apart and read in those rounds alone that reach a hub, so most rounds
touch the few edges of the other nodes. Graphs within the kernel's bounds are swept by kernel.py instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heftgraph.operators.kernel import WORD
from heftgraph.operators.storage import root, stored


#: Edges that start at a node from which on it is a hub; there are at most so many times fewer hubs than edges.
HUB = 64
#: Rows of a round that may be broadcast, counted before: 20 bytes each.
FRONT = 500_000


def fronts(new: DataFrame, edges: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The rows of new(node, ...), stored, that are hubs and those that aren't, each with the edges(src, dst, hub, ...) that start there; of neither, if there are none."""
    counts = {r["hub"]: r["count"] for r in new.groupBy(F.expr("cast(node % 2 as int)").alias("hub")).count().collect()}
    out = []
    for hub, n in sorted(counts.items()):
        own = new.filter(F.expr("cast(node % 2 as int)") == hub)
        out.append((F.broadcast(own) if n <= FRONT else own, edges.filter(F.col("hub") == hub)))
    return out


def numbered(cuts: DataFrame) -> DataFrame:
    """cut_id, word, k, bit of every one of cuts(cut_id): its bit is the k-th of its word."""
    at = F.row_number().over(Window.orderBy("cut_id")) - 1
    placed = cuts.select("cut_id").distinct().select("cut_id", at.alias("at"))
    return stored(placed.selectExpr("cut_id", f"cast(at div {WORD} as int) as word", f"at % {WORD} as k", f"shiftleft(1L, at % {WORD}) as bit"))


def reach_bits(edges: DataFrame, starts: DataFrame, severed: DataFrame | None = None) -> DataFrame:
    """node, word, bits reached from starts(node, word, bits) along edges(src, dst, hub, cut_target); severed(cut_target, word, mask): the bits that don't pass. Without severed, edges may have a mask: the bits that pass."""
    spark = edges.sparkSession
    path, schema = f"{root(spark)}/reached-{uuid.uuid4().hex}", "node long, word int, bits long"
    starts.groupBy("node", "word").agg(F.expr("bit_or(bits)").alias("bits")).filter("bits <> 0").write.parquet(f"{path}/round=0")
    rounds = 0
    while True:
        new = spark.read.schema(schema).parquet(f"{path}/round={rounds}")
        seen = spark.read.schema(schema).parquet(*(f"{path}/round={k}" for k in range(rounds + 1)))
        both = seen.select("node", "word", F.lit(0).cast("long").alias("more"), F.col("bits").alias("had"))
        parts = fronts(new, edges)
        if not parts:
            return seen.groupBy("node", "word").agg(F.expr("bit_or(bits)").alias("bits"))
        for front, own in parts:
            step = own.join(front, F.col("node") == F.col("src"))
            if severed is None and "mask" in own.columns:
                step = step.select(F.col("dst").alias("node"), "word", F.expr("bits & mask").alias("more"))
            elif severed is None:
                step = step.select(F.col("dst").alias("node"), "word", F.col("bits").alias("more"))
            else:
                # a row a target and word that any cut severs
                step = step.join(F.broadcast(severed), ["cut_target", "word"], "left").select(F.col("dst").alias("node"), "word", F.expr("bits & ~coalesce(mask, 0L)").alias("more"))
            both = both.unionByName(step.filter("more <> 0").withColumn("had", F.lit(0).cast("long")))
        both = both.groupBy("node", "word").agg(F.expr("bit_or(more)").alias("more"), F.expr("bit_or(had)").alias("had"))
        rounds += 1
        both.select("node", "word", F.expr("more & ~had").alias("bits")).filter("bits <> 0").write.parquet(f"{path}/round={rounds}")


def masks(severed: DataFrame, cuts: DataFrame) -> DataFrame:
    """cut_target, word, mask of severed(cut_id, target) over numbered cuts."""
    return stored(severed.filter("target is not null").join(cuts, "cut_id").groupBy(F.col("target").alias("cut_target"), "word").agg(F.expr("bit_or(bit)").alias("mask")))


def reach(edges: DataFrame, starts: DataFrame, severed: DataFrame) -> DataFrame:
    """cut_id, node reached from starts(cut_id, node) along edges(src, dst, hub, cut_target), where severed(cut_id, target) doesn't cut them."""
    starts = starts.select(F.col("cut_id").cast("string").alias("cut_id"), "node")
    cuts = numbered(starts)
    found = reach_bits(edges.select("src", "dst", "hub", "cut_target"), starts.join(cuts, "cut_id").select("node", "word", F.col("bit").alias("bits")), masks(severed, cuts))
    return found.join(cuts, "word").filter("bits & bit <> 0").select("cut_id", "node")
