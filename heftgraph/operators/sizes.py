"""Size attribution: symbols to bytes, packages, modules and report breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heftgraph.functions.scalars import symbol_package


def symbol_sizes(symbols: DataFrame, sections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """symbols(*by, sect, addr, name) with bytes up to the next symbol, or to the section's end; by names the executable."""
    # a window holds the symbols of one section of one executable
    order = Window.partitionBy(*by, "sect").orderBy("addr", "name")
    held = sections.filter("file_backed and not is_pclntab and not contains(name, 'debug') and not contains(name, 'DWARF')")
    s = symbols.join(held.select(*by, "sect", F.col("size").alias("end"), "is_text"), [*by, "sect"])
    s = s.withColumn("bytes", F.coalesce(F.lead("addr").over(order), F.col("end")) - F.col("addr"))
    return s.filter("bytes >= 0").select(*by, "sect", "addr", "name", "is_text", "bytes")


def package_sizes(sized: DataFrame, pclntab: int | DataFrame, by: tuple[str, ...] = (), data: bool = False) -> DataFrame:
    """*by, pkg, bytes, code_bytes, if asked data_bytes, with each package's share of the line table, of pclntab(*by, pclntab) bytes, by its code."""
    own = sized.groupBy(*by, symbol_package(F.col("name")).alias("pkg")).agg(F.sum("bytes").alias("b"), F.sum(F.when(F.col("is_text"), F.col("bytes")).otherwise(0)).alias("code_bytes"))
    if by:  # the symbols are followed once
        joined = own.withColumn("t", F.sum("code_bytes").over(Window.partitionBy(*by)))
    else:
        joined = own.crossJoin(own.agg(F.sum("code_bytes").alias("t")))
    if isinstance(pclntab, DataFrame):
        joined = joined.join(pclntab, list(by), "left").withColumn("p", F.coalesce("pclntab", F.lit(0)))
    else:
        joined = joined.withColumn("p", F.lit(pclntab))
    share = F.when(F.col("t") > 0, F.expr("cast(cast(p as decimal(38,0)) * code_bytes div t as long)")).otherwise(0)
    return joined.select(*by, "pkg", (F.col("b") + share).alias("bytes"), "code_bytes", *([(F.col("b") - F.col("code_bytes")).alias("data_bytes")] if data else []))


def module_sizes(packages: DataFrame) -> DataFrame:
    """module, bytes, packages over packages(pkg, module, size)."""
    return packages.groupBy("module").agg(F.sum("size").alias("bytes"), F.count("*").alias("packages"))
