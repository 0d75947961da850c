"""A weighted dependency graph derived from the star-schema tables, and its symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.operators.build import Build, together
from heftgraph.operators.policy import Policy
from heftgraph.operators.prune import Graph
from heftgraph.operators.storage import fingerprint, stands, stored

MAIN = "app"
CONTROLLED = Policy(controlled=("region/...",))
TABLES = ("region", "nation", "supplier", "part", "lineitem")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    region, supplier, part = (read(spark, sf_dir, t) for t in ("region", "supplier", "part"))
    main = spark.createDataFrame([("app/main", MAIN, 10)], "pkg string, module string, size long")
    rows = [
        region.select(F.concat(F.lit("region/"), "r_regionkey"), F.concat(F.lit("region/"), "r_name"), F.lit(100).cast("long")),
        nation.select(F.concat(F.lit("nation/"), "n_nationkey"), F.concat(F.lit("nation/"), "n_name"), F.lit(1000).cast("long")),
        supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier/"), "s_suppkey"), F.concat(F.lit("nation/"), "n_name"), F.round(F.abs("s_acctbal") * 100).cast("long")),
        part.select(F.concat(F.lit("part/"), "p_partkey"), F.when(F.col("p_size") <= 5, "").otherwise(F.concat(F.lit("brand/"), "p_brand")), F.round(F.col("p_retailprice") * 100).cast("long")),
    ]
    for r in rows:
        main = main.union(r)
    return main


def edges(spark: SparkSession, sf_dir: str, line_filter: str = "true", once: bool = True) -> DataFrame:
    """src, dst of every edge; if not once, those that repeat are left to the reader."""
    region, nation, supplier, part, line = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part", "lineitem"))
    keyed = lambda d, src, a, dst, b: d.select(F.lit(src).alias("x"), F.col(a).cast("long").alias("a"), F.lit(dst).alias("y"), F.expr(b).cast("long").alias("b"))
    out = region.select(F.lit("app/main").alias("x"), F.lit(None).cast("long").alias("a"), F.lit("region/").alias("y"), F.col("r_regionkey").cast("long").alias("b"))
    out = out.union(keyed(nation, "region/", "n_regionkey", "nation/", "n_nationkey"))
    out = out.union(keyed(supplier, "nation/", "s_nationkey", "supplier/", "s_suppkey"))
    out = out.union(keyed(line.filter(line_filter), "supplier/", "l_suppkey", "part/", "l_partkey"))
    out = out.union(keyed(part.filter("p_partkey >= 2"), "part/", "p_partkey", "part/", "p_partkey div 2"))
    # keys are shorter than names
    return (out.distinct() if once else out).select(F.when(F.col("x") == "app/main", F.col("x")).otherwise(F.concat("x", "a")).alias("src"), F.concat("y", "b").alias("dst"))


#: Builds that stay, the last ones that were asked for.
KEPT = 6
_kept: dict[tuple, object] = {}


def held(spark: SparkSession, sf_dir: str, *what, make, good, tables: tuple[str, ...] = TABLES) -> object:
    """What make() gives for these tables, kept as long as the session lives, the tables' files stay as they are and it is good."""
    files = fingerprint(spark, *(f"{sf_dir}/{t}.parquet" for t in tables))
    key = (spark.sparkContext.applicationId, sf_dir, *what, files)
    found = _kept.pop(key, None)
    if found is None or not good(found):
        found = make()
    _kept[key] = found
    while len(_kept) > KEPT:
        _kept.pop(next(iter(_kept)))
    return found


def _parts(spark: SparkSession, sf_dir: str, line_filter: str, once: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    return packages(spark, sf_dir), edges(spark, sf_dir, line_filter, once), spark.createDataFrame([("app/main",)], "pkg string")


def build(spark: SparkSession, sf_dir: str, small: bool = True) -> Build:
    """The build of these tables; queries share it."""
    return held(spark, sf_dir, small, make=lambda: Build(*_parts(spark, sf_dir, "true"), small), good=Build.stands)


def _side(spark: SparkSession, sf_dir: str, flag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The build of the lines of a return flag, in which each of a part's lines adds a byte to it."""
    pkgs, links, roots = _parts(spark, sf_dir, f"l_returnflag = '{flag}'", False)
    # keys are shorter than names
    lines = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("part/"), "l_partkey").alias("pkg"), "n")
    return pkgs.join(lines, "pkg", "left").select("pkg", "module", (F.col("size") + F.coalesce("n", F.lit(0))).alias("size")), links, roots


def sides(spark: SparkSession, sf_dir: str, flags: tuple[str, ...] = ("R", "A")) -> DataFrame:
    """label, pkg, module, size of what is reachable in the builds of the lines of each return flag."""
    return held(spark, sf_dir, flags, make=lambda: stored(together({f: _side(spark, sf_dir, f) for f in flags})), good=stands)


def graph(spark: SparkSession, sf_dir: str, policy: Policy = CONTROLLED, small: bool = True) -> Graph:
    return Graph.over(build(spark, sf_dir, small), MAIN, policy)


#: Seven sections over line numbers: name, file-backed, text, line table.
SECTIONS = ((0, ".text", True, True, False), (1, ".rodata", True, False, False), (2, ".gopclntab", True, False, True), (3, ".debug_info", True, False, False), (4, ".bss", False, False, False), (5, ".data", True, False, False), (6, ".noptrdata", True, False, False))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    line = read(spark, sf_dir, "lineitem")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_linenumber") - 1).alias("sect"), (F.col("l_orderkey") * 64 + F.col("l_suppkey") % 64).alias("addr"), F.concat(F.lit("mod%2eorg/"), F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.lit(".S"), F.col("l_partkey")).alias("name"))


def sections(spark: SparkSession, syms: DataFrame) -> DataFrame:
    size = syms.groupBy("sect").agg((F.max("addr") + 64).alias("size"))
    return spark.createDataFrame(list(SECTIONS), "sect int, name string, file_backed boolean, is_text boolean, is_pclntab boolean").join(size, "sect")
