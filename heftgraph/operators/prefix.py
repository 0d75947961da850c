"""Which module a path lies in: an exact listing first, else the longest module that is the path or above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def above(path: Column) -> Column:
    """The path and all paths above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest(paths: DataFrame, column: str, modules: DataFrame) -> DataFrame:
    """column, module for every distinct path that lies in one of modules(module): an equi-join on the paths above, never a comparison of all pairs."""
    known = modules.filter("module <> ''").select("module").distinct()
    every = paths.select(column).distinct().select(column, F.explode(above(F.col(column))).alias("module"))
    return every.join(known, "module").groupBy(column).agg(F.max_by("module", F.length("module")).alias("module"))


def owners(paths: DataFrame, column: str, packages: DataFrame, modules: DataFrame) -> DataFrame:
    """column, module for every distinct path: that of packages(pkg, module) if listed, else the longest; '' for none."""
    listed = packages.select(F.col("pkg").alias(column), F.col("module").alias("own")).distinct()
    distinct = paths.select(column).distinct().join(listed, column, "left")
    found = longest(distinct.filter("own is null"), column, modules)
    return distinct.join(found, column, "left").select(column, F.coalesce("own", "module", F.lit("")).alias("module"))
