"""Links between documents: connected components, and pairs with both texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import broadcast_if_small, forget, release, settle, texts


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of edges(u > v) has one v, and no v is a u: then v is its component's smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("us"), F.lit(0).alias("vs")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("us"), F.lit(1).alias("vs")))
    return not ends.groupBy("node").agg(F.sum("us").alias("us"), F.max("vs").alias("vs")).filter("us > 1 or us > 0 and vs > 0").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for every node of edges(u, v); self-loops count as nodes.

    Alternates large-star and small-star until the edges are stars around the smallest nodes. Hubs
    are met by joins of two stored tables, whose large partitions Spark can split.
    """
    raw = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null")
    if raw.isEmpty():
        return edges.sparkSession.createDataFrame([], "node long, label long")
    alone = settle(raw.filter("u = v").select("u").distinct(), "loops")
    now = settle(raw.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settle(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        floor = settle(large.groupBy("u").agg(F.min("v").alias("m")), "floor")
        small = large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = settle(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(now, least, large, floor)
        now = new
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("label")))
    return settle(nodes.groupBy("node").agg(F.min("label").alias("label")), "components")


def compared(pairs: DataFrame, docs: DataFrame, compare, schema: str, tag: str) -> DataFrame:
    """What compare (for mapInArrow) makes of pairs(a, b) with text_a and text_b, stored; only texts of paired documents are moved, from docs itself."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "paired")
    own = texts(docs).join(broadcast_if_small(ids), "doc_id", "left_semi")
    left = own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    out = settle(pairs.join(left, "a").join(right, "b").mapInArrow(compare, schema), tag)
    forget(ids)
    release(pairs.sparkSession)
    return out
