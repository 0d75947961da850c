"""Version floors, snapshot diffs, platform roll-ups and budget gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heftgraph.functions.scalars import version_key


def floor(modules: DataFrame, by: str = "graph_id") -> DataFrame:
    """by, version, critical, next_version, owned_max of modules(by, module, version, owned).

    version is the highest directive among modules that aren't owned, critical those that have it,
    next_version the highest below it. Without any, only owned_max is given.
    """
    m = modules.withColumn("key", version_key(F.col("version")))
    top = m.groupBy(by).agg(F.max(F.when(~F.col("owned"), F.col("key"))).alias("top"))
    m = m.join(top, by)
    foreign = ~F.col("owned")
    at_top = foreign & F.col("key").isNotNull() & (F.col("key") == F.col("top"))
    pick = lambda cond: F.coalesce(F.max_by(F.when(cond, F.col("version")), F.when(cond, F.col("key"))), F.lit(""))
    return m.groupBy(by).agg(
        pick(at_top).alias("version"),
        F.array_join(F.array_sort(F.collect_set(F.when(at_top, F.col("module")))), ",").alias("critical"),
        pick(foreign & (F.col("key") < F.col("top"))).alias("next_version"),
        pick(F.col("owned") & F.col("key").isNotNull()).alias("owned_max"),
    )


def diff(base: DataFrame, head: DataFrame, main: str) -> DataFrame:
    """module, status, base_size, head_size, delta of two module(module, size) tables; equal sizes are left out."""
    b, h = base.withColumnRenamed("size", "b"), head.withColumnRenamed("size", "h")
    out = b.join(h, "module", "full_outer").filter(F.col("module") != main)
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b") != F.col("h"), "changed")
    return out.withColumn("status", status).filter("status is not null").select("module", "status", F.coalesce("b", F.lit(0)).alias("base_size"), F.coalesce("h", F.lit(0)).alias("head_size"), (F.coalesce("h", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


def presence(cells: DataFrame, n_cells: int) -> DataFrame:
    """module, in_cells, universal over cells(label, module)."""
    return cells.select("label", "module").distinct().groupBy("module").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("in_cells"), (F.count("*") == n_cells).alias("universal"))


def verdict(floors: DataFrame) -> DataFrame:
    """can_lower_now, lower_to, blocked_by, then_reaches: whether one's own modules declare more than the others need."""
    own, need = version_key(F.col("owned_max")), version_key(F.col("version"))
    can = (F.col("owned_max") != "") & ((F.col("version") == "") | F.coalesce(own > need, F.lit(False)))
    return floors.select(can.alias("can_lower_now"), F.when(can, F.col("version")).otherwise("").alias("lower_to"), F.col("critical").alias("blocked_by"), F.col("next_version").alias("then_reaches"))


def worst_floor(floors: DataFrame, by: str) -> DataFrame:
    """by, version, pins: whether a platform's floor is the highest of all."""
    worst = floors.agg(F.max_by("version", version_key(F.col("version"))).alias("worst"))
    return floors.crossJoin(F.broadcast(worst)).select(by, "version", (F.col("version") == F.col("worst")).alias("pins"))


def diff_floor(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, direction (-1, 0, 1), newly_critical of two floors."""
    b, a = (x.select(F.col("version").alias(n), F.col("critical").alias(n + "_critical")) for x, n in ((before, "before"), (after, "after")))
    kb, ka = version_key(F.col("before")), version_key(F.col("after"))
    up = F.coalesce(ka > kb, ka.isNotNull() & kb.isNull())
    down = F.coalesce(ka < kb, kb.isNotNull() & ka.isNull())
    new = F.array_except(F.split("after_critical", ","), F.split("before_critical", ","))
    return b.crossJoin(a).select("before", "after", F.when(up, 1).when(down, -1).otherwise(0).alias("direction"), F.array_join(F.array_sort(new), ",").alias("newly_critical"))


def worst(floors: DataFrame) -> DataFrame:
    """One row: version, critical, next_version, owned_max over the floors of all platforms.

    The highest version counts, with the modules that ask for it on any platform; next is the
    highest that is left when those go.
    """
    own = version_key(F.col("version"))
    top = floors.agg(F.max_by("version", own).alias("worst"), F.max_by("owned_max", version_key(F.col("owned_max"))).alias("owned"))
    tied = (F.col("version") == F.col("worst")) & (F.col("worst") != "")
    at = floors.crossJoin(top).withColumn("left", F.when(tied, F.col("next_version")).otherwise(F.col("version")))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(tied, F.split("critical", ","))))))
    out = at.agg(F.max("worst").alias("version"), F.array_join(F.array_remove(names, ""), ",").alias("critical"), F.max_by("left", version_key(F.col("left"))).alias("next_version"), F.max("owned").alias("owned_max"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(*map(blank, ("version", "critical", "next_version", "owned_max")))


def matrix_rows(cells: DataFrame, versions: DataFrame) -> DataFrame:
    """module, version, in_cells, universal, size_by_cell, max_size over cells(label, module, pkg, size) of the platforms that were built."""
    n = cells.agg(F.count_distinct("label").alias("n"))
    own = cells.groupBy("module", "label").agg(F.sum("size").alias("size"))
    by = own.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("in_cells"), F.count("*").alias("k"), F.map_from_entries(F.collect_list(F.struct("label", "size"))).alias("size_by_cell"), F.max("size").alias("max_size"))
    named = by.join(versions, "module", "left").crossJoin(n)
    return named.select("module", F.coalesce("version", F.lit("")).alias("version"), "in_cells", (F.col("k") == F.col("n")).alias("universal"), "size_by_cell", "max_size")


def diff_totals(changes: DataFrame, direct: DataFrame) -> DataFrame:
    """status, modules, net, transitive (modules that aren't in direct(module)) of diff() rows."""
    named = changes.join(direct.select("module", F.lit(True).alias("direct")).distinct(), "module", "left")
    return named.groupBy("status").agg(F.count("*").alias("modules"), F.sum("delta").alias("net"), F.count_if(F.col("direct").isNull()).alias("transitive"))


def headline(candidates: DataFrame) -> DataFrame:
    """targets, easiest (most freed alone), easiest_bytes, biggest (largest prize), biggest_bytes of candidates(module, freed_bytes, prize_bytes)."""
    return candidates.agg(F.count("*").alias("targets"), F.max_by("module", F.struct("freed_bytes", "module")).alias("easiest"), F.max("freed_bytes").alias("easiest_bytes"), F.max_by("module", F.struct("prize_bytes", "module")).alias("biggest"), F.max("prize_bytes").alias("biggest_bytes"))
