"""Intermediate tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None

#: Bytes of a batch of large rows on its way to a Python worker.
BATCH_BYTES = 8 << 20


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a folder of our own in local mode (tests), an error on a cluster."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="heftgraph-")
    return _own


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df, written to the shared folder (in folders by columns, if named) and read back: its lineage ends in files that outlive executors."""
    path = f"{root(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> None:
    """Bound the batches of this session by bytes too, unless it sets a bound itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, *names: str) -> tuple:
    """Name, length and time of change of every file under these names."""
    out = []
    for name in names:
        path, fs = _path(spark, name)
        files = fs.listStatus(path) if fs.exists(path) else ()
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(out))


def stands(df: DataFrame) -> bool:
    """Whether the files of a stored table are still there."""
    for name in df.inputFiles():
        path, fs = _path(df.sparkSession, name)
        if not fs.exists(path):
            return False
    return True
