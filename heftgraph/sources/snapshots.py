"""Stored analyses: the tables of one build under its key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def store(tables: dict[str, DataFrame], folder: str, key: str) -> None:
    """Write all tables beside, then rename, so that a reader finds all of them or none; a key that is there stays."""
    spark = next(iter(tables.values())).sparkSession
    beside = f"{folder.rstrip('/')}/.{key}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{beside}/{name}")
    source, fs = _path(spark, beside)
    target, _ = _path(spark, f"{folder.rstrip('/')}/{key}")
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)


def load(spark: SparkSession, folder: str, key: str) -> dict[str, DataFrame] | None:
    """The tables under a key, None if there are none."""
    target, fs = _path(spark, f"{folder.rstrip('/')}/{key}")
    if not fs.exists(target):
        return None
    return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(target) if s.isDirectory()}


def changed(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """table, rows_gone, rows_new of the tables that two snapshots share and that differ."""
    out = None
    for name in sorted(before.keys() & after.keys()):
        a, b = before[name], after[name].select(before[name].columns)
        row = a.exceptAll(b).agg(F.count("*").alias("rows_gone")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("rows_new"))).select(F.lit(name).alias("table"), "rows_gone", "rows_new")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("the snapshots share no table")
    return out.filter("rows_gone > 0 or rows_new > 0")
