"""Orders of results: a place for every row, without sorting them all in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftgraph.functions.scalars import version_key
from heftgraph.operators.storage import stored

#: Orders by name: largest first, then by name.
ORDERS: dict[str, list] = {
    "size": [F.desc, "size", "module"],
    "explorer": [F.desc, "prize_bytes", F.desc, "size", "module"],
    "prize": [F.desc, "prize_bytes", "module"],
    "candidates": [F.desc, "prize_bytes", F.desc, "freed_bytes", "module"],
    "bytes": [F.desc, "bytes", "module"],
    "blame": [F.desc, "blame", "module"],
    "entries": [F.desc, "retained", "pkg"],
    "name": ["module"],
    "sites": ["path", "line", "import"],
}


def named(name: str) -> list[Column]:
    """The columns to sort by; 'change' is by absolute delta, 'version' by version, 'matrix' puts platform-specific modules first."""
    if name == "change":
        return [F.desc(F.abs("delta")), F.col("module")]
    if name == "version":
        return [F.desc_nulls_last(version_key(F.col("version"))), F.col("module")]
    if name == "matrix":
        return [F.col("universal"), F.desc_nulls_last(version_key(F.col("version"))), F.col("module")]
    out, fall = [], False
    for x in ORDERS[name]:
        if callable(x):
            fall = True
        else:
            out.append(F.desc(x) if fall else F.col(x))
            fall = False
    return out


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place, from 1 on: ranges are sorted apart, and their sizes summed."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    kept = stored(ranges.select("*", F.spark_partition_id().alias("_range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    # one row a range
    before = kept.groupBy("_range").agg(F.count("*").alias("n")).select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("before"))
    return kept.join(before, "_range").select(*df.columns, (F.col("before") + F.col("_at") + 1).alias("place"))
