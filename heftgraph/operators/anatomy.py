"""What executables are made of: totals by content, bytes by package, module and owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.functions.scalars import symbol_package
from heftgraph.operators import sizes
from heftgraph.operators.prefix import owners
from heftgraph.sources import binaries

BY = ("path",)


def counted(files: DataFrame) -> DataFrame:
    """The sections that count: stored in the file and not for debuggers."""
    return binaries.sections(files).filter("file_backed and not contains(name, 'debug') and not contains(name, 'DWARF')")


def packages(files: DataFrame) -> DataFrame:
    """path, pkg, bytes, code_bytes, data_bytes: by symbols with their share of the line table, or by the functions of stripped files."""
    sized = sizes.symbol_sizes(binaries.symbols(files), binaries.sections(files), BY)
    table = counted(files).filter("is_pclntab").groupBy("path").agg(F.max("size").alias("pclntab"))
    whole = sizes.package_sizes(sized, table, BY, True)
    code = binaries.function_sizes(files).groupBy("path", symbol_package(F.col("name")).alias("pkg")).agg(F.sum("size").alias("bytes"))
    return whole.unionByName(code.select("path", "pkg", "bytes", F.col("bytes").alias("code_bytes"), F.lit(0).cast("long").alias("data_bytes")))


def owned(own: DataFrame, listed: DataFrame, modules: DataFrame, main: str) -> DataFrame:
    """own(path, pkg, ...) with module ('' for none) and owner: generated, std, main or module."""
    named = own.join(owners(own, "pkg", listed, modules), "pkg", "left")
    none = F.col("module") == ""
    owner = F.when(none & ((F.col("pkg") == "") | F.col("pkg").startswith("<")), "generated").when(none, "std").when(F.col("module") == main, "main").otherwise("module")
    return named.withColumn("owner", owner)


def module_sizes(named: DataFrame) -> DataFrame:
    """path, module, size of all modules, the main one too."""
    return named.filter("module <> ''").groupBy("path", "module").agg(F.sum("bytes").alias("size"))


def summary(files: DataFrame, named: DataFrame) -> DataFrame:
    """One row a file: path, binary_size, accounted_size, code_size, data_size, pclntab_size, std_size, main_size, generated_size, stripped."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    held = counted(files).groupBy("path").agg(F.sum("size").alias("accounted_size"), F.sum(F.when(F.col("is_pclntab"), F.col("size"))).alias("pclntab_size"))
    of = lambda kind: F.sum(F.when(F.col("owner") == kind, F.col("bytes"))).alias(f"{kind}_size")
    own = named.groupBy("path").agg(F.sum("code_bytes").alias("code_size"), F.sum("data_bytes").alias("data_size"), of("std"), of("main"), of("generated"))
    out = files.filter("part = 0").select("path", F.col("file_size").alias("binary_size"), "stripped").join(held, "path", "left").join(own, "path", "left")
    return out.select("path", "binary_size", *map(zero, ("accounted_size", "code_size", "data_size", "pclntab_size", "std_size", "main_size", "generated_size")), "stripped")


def breakdown(totals: DataFrame, modules: DataFrame, main: str) -> DataFrame:
    """path, part, bytes: by content (code, data, line table), and by owner (third-party, main, std, generated)."""
    foreign = modules.filter(F.col("module") != main).groupBy("path").agg(F.sum("size").alias("third_party_size"))
    out = totals.join(foreign, "path", "left")
    parts = {"code": "code_size", "data": "data_size", "line table": "pclntab_size", "third-party": "third_party_size", "main": "main_size", "std": "std_size", "generated": "generated_size"}
    each = F.array(*(F.struct(F.lit(k).alias("part"), F.coalesce(F.col(c), F.lit(0)).alias("bytes")) for k, c in parts.items()))
    return out.select("path", F.explode(each).alias("x")).select("path", "x.*")
