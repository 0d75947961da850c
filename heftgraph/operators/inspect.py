"""One module in full: its bytes, entries, what it drags out, and what its cut does to the floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.functions.scalars import version_key
from heftgraph.operators import entry, reports, session
from heftgraph.operators.prune import Graph


def _potential(g: Graph, module: str) -> DataFrame:
    """bytes within reach of a module that leave when all targets are cut."""
    spark = g.roots.sparkSession
    start = g.nodes.filter(F.col("module") == module).select(F.lit("m").alias("cut_id"), F.col("pkg").alias("node"))
    inside = g.reached(spark.createDataFrame([("m", None)], "cut_id string, target string"), start).select("pkg")
    gone = g.leaving(g.targets.select(F.lit("all").alias("cut_id"), "target"))
    return gone.join(inside, "pkg", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("potential_bytes"))


def _versions(modules: DataFrame, versions: DataFrame, g: Graph) -> DataFrame:
    """graph_id, module, version, owned of modules(module)."""
    own = g.classes.select("module", F.col("class").isin("main", "1st").alias("owned"))
    named = modules.filter("module <> ''").select("module").distinct().join(own, "module")
    return named.join(versions, "module", "left").select(F.lit("all").alias("graph_id"), "module", F.coalesce("version", F.lit("")).alias("version"), "owned")


def floor_of(g: Graph, versions: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """The floor of what is left when a selection is cut, of versions(module, version); one row, of '' if nothing asks for a version."""
    rows = [("all", t) for t in selected or ()] + [("all", None)]
    left = g.reached(g.roots.sparkSession.createDataFrame(rows, "cut_id string, target string"))
    return reports.floor(_versions(left, versions, g))


def inspect(g: Graph, module: str, versions: DataFrame) -> DataFrame:
    """One row: module, class, locked, controlled, target, size, version, freed_bytes, potential_bytes, floor_before, floor_after, moves_floor.

    freed_bytes is what leaves with the module. A module that isn't in the build raises; one
    that is no target frees nothing and has no floor after its cut.
    """
    own = g.base.filter(F.col("module") == module)
    if own.isEmpty() or not module:
        raise ValueError(f"module {module!r} is not in the build")
    facts = g.classes.filter(F.col("module") == module)
    is_target = facts.filter("target").count() > 0
    size = own.agg(F.sum("size").alias("size"))
    one = g.roots.sparkSession.createDataFrame([(module, module)], "cut_id string, target string")
    freed = g.freed_by(one).select(F.col("bytes").alias("freed_bytes")) if is_target else size.select(F.lit(0).cast("long").alias("freed_bytes"))
    before = floor_of(g, versions).select(F.col("version").alias("floor_before"))
    after = floor_of(g, versions, [module]).select(F.col("version").alias("floor_after")) if is_target else before.select(F.lit("").alias("floor_after"))
    low = F.col("floor_after") == ""
    moves = F.when(F.lit(is_target), F.when(low, F.col("floor_before") != "").otherwise(F.coalesce(version_key(F.col("floor_after")) < version_key(F.col("floor_before")), F.lit(False)))).otherwise(False)
    out = facts.select("module", "class", "locked", "controlled", "target").join(versions, "module", "left")
    for one in (size, freed, _potential(g, module), before, after):  # one row each
        out = out.crossJoin(one)
    return out.select("module", "class", "locked", "controlled", "target", "size", F.coalesce("version", F.lit("")).alias("version"), "freed_bytes", "potential_bytes", "floor_before", "floor_after", moves.alias("moves_floor"))


def entries(g: Graph, module: str, sites: DataFrame | None = None) -> DataFrame:
    """pkg, retained, imported_by (sorted, joined by commas) of a module's entries: by import sites(from_package, import), or else by controlled packages of the graph."""
    own = entry.entry_weights(g).filter(F.col("module") == module).select("pkg", "retained")
    if sites is None:
        sites = g.hops.filter(F.col("cut_target") == module).select(F.col("src").alias("from_package"), F.col("dst").alias("import"))
    by = sites.groupBy(F.col("import").alias("pkg")).agg(F.array_join(F.array_sort(F.collect_set("from_package")), ",").alias("imported_by"))
    return own.join(by, "pkg", "left").select("pkg", "retained", F.coalesce("imported_by", F.lit("")).alias("imported_by"))


def drags(g: Graph, module: str) -> DataFrame:
    """module, bytes, freed, needed_by: what leaves with a module, and what stays and who holds it."""
    return session.drag_out(g, module)
