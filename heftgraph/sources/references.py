"""Linker reference dumps: lines 'symbol -> symbol', which witness the packages that survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.functions.scalars import GENERATED, is_aux_symbol, symbol_package

ARROW = " -> "


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def live_packages(lines: DataFrame, packages: DataFrame, main_package: str) -> DataFrame:
    """pkg of known packages with a symbol on either side of a line; symbols of 'main' belong to main_package."""
    value = F.col("value")
    at = F.instr(value, ARROW)
    ends = lines.filter((value != "") & ~value.startswith("#") & (at > 0))
    name = ends.select(F.explode(F.array(F.substring(value, F.lit(1), at - 1), F.substring(value, at + len(ARROW), F.length(value)))).alias("name"))
    name = name.select(F.trim("name").alias("name")).distinct().filter(~is_aux_symbol(F.col("name")))
    pkg = symbol_package(F.col("name"))
    found = name.select(F.when(pkg == "main", main_package).otherwise(pkg).alias("pkg")).filter(F.col("pkg") != GENERATED)
    return found.distinct().join(packages, "pkg", "left_semi")


def narrowed(edges: DataFrame, live: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between live packages or roots; all edges where nothing was witnessed."""
    if live.isEmpty():
        return edges
    kept = live.select("pkg").union(roots.select("pkg")).distinct()
    return edges.join(kept.withColumnRenamed("pkg", "src"), "src", "left_semi").join(kept.withColumnRenamed("pkg", "dst"), "dst", "left_semi").select("src", "dst")
