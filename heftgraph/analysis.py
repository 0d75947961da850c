"""One build from its artifacts, and the questions that reports and tools ask of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.functions import scalars
from heftgraph.operators import anatomy, budget, entry, order, reports, session
from heftgraph.operators import inspect as inspection
from heftgraph.operators.build import together
from heftgraph.operators.policy import Policy, matches
from heftgraph.operators.prune import Graph
from heftgraph.operators.storage import stored
from heftgraph.sources import binaries, imports, modules, references


@dataclass
class Analysis:
    """files (FILE rows of one executable), listing (packages()), imports(src, dst), and maybe a linker's dump(value) and sources(path, text)."""

    spark: SparkSession
    files: DataFrame
    packages: DataFrame
    imports: DataFrame
    policy: Policy
    dump: DataFrame | None = None
    sources: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, binary: str, listing: str, policy: Policy, dump: str | None = None, sources: str | None = None) -> Analysis:
        """From files: an executable, its package listing, a reference dump and the main module's source tree."""
        listed = stored(modules.read(spark, listing))
        return cls(spark, stored(binaries.read(spark, binary)), stored(modules.packages(listed)), stored(modules.imports(listed)), policy, references.read(spark, dump) if dump else None, imports.read(spark, sources) if sources else None)

    def reclassified(self, policy: Policy) -> Analysis:
        """The same artifacts under another policy; what no policy changes is not made anew."""
        out = Analysis(self.spark, self.files, self.packages, self.imports, policy, self.dump, self.sources)
        for name in ("main", "owned", "versions", "size", "coupling"):
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name]
        out.__dict__["graph"] = self.graph.reclassified(policy)
        return out

    @cached_property
    def main(self) -> str:
        found = self.packages.filter("is_main").select("module").distinct().limit(1).collect()
        return found[0][0] if found else ""

    @cached_property
    def owned(self) -> DataFrame:
        return stored(anatomy.owned(anatomy.packages(self.files), self.packages, self.packages.select("module"), self.main))

    @cached_property
    def versions(self) -> DataFrame:
        """module, version: the directive that each module declares."""
        first = self.packages.filter("module <> ''").groupBy("module").agg(F.min_by("go_version", "at").alias("version"))
        return stored(first)

    @cached_property
    def graph(self) -> Graph:
        roots = modules.roots(self.packages)
        edges = self.imports
        if self.dump is not None:
            edges = references.narrowed(edges, references.live_packages(self.dump, self.packages.select("pkg"), roots.agg(F.min("pkg")).first()[0]), roots)
        bytes_ = self.owned.groupBy("pkg").agg(F.sum("bytes").alias("size"))
        sized = self.packages.select("pkg", "module").join(bytes_, "pkg", "left").select("pkg", "module", F.coalesce("size", F.lit(0)).alias("size"))
        return Graph(sized, edges, roots, self.main, self.policy)

    @cached_property
    def session(self) -> session.Session:
        """The build as one that can be asked under other policies."""
        g = self.graph
        return session.Session(g.build, self.main, self.policy, self.versions, self.coupling)

    @cached_property
    def size(self) -> DataFrame:
        return stored(anatomy.summary(self.files, self.owned))

    def size_modules(self, hide_locked: bool = False) -> DataFrame:
        """module, size, direct, class, version, locked, place of the modules that have bytes."""
        direct = self.packages.filter("module <> ''").groupBy("module").agg(F.max("direct").alias("direct"))
        out = anatomy.module_sizes(self.owned).drop("path").join(direct, "module", "left").join(self.graph.classes.select("module", "class", "locked"), "module", "left").join(self.versions, "module", "left")
        out = out.select("module", "size", F.coalesce("direct", F.lit(False)).alias("direct"), F.coalesce("class", F.lit("3rd")).alias("class"), F.coalesce("version", F.lit("")).alias("version"), F.coalesce("locked", F.lit(False)).alias("locked"))
        return order.ranked(out.filter("not locked") if hide_locked else out, order.named("size"))

    def sections(self) -> DataFrame:
        return anatomy.counted(self.files).select("name", "size")

    @cached_property
    def coupling(self) -> DataFrame:
        """module, import_sites, importing_packages, distinct_symbols; empty without sources."""
        if self.sources is None:
            return self.spark.createDataFrame([], "module string, import_sites long, importing_packages long, distinct_symbols long")
        return stored(imports.coupling(self.sources, self.packages.select("pkg", "module", "name"), self.main))

    def candidates(self) -> DataFrame:
        """The prune table with class, coupling, effort and place."""
        g = self.graph
        out = g.candidates().join(g.classes.select("module", "class"), "module").join(self.coupling, "module", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = out.select("module", "class", "prize_bytes", "freed_bytes", "freed_packages", "potential_bytes", "shared_bytes", "pinned_by", zero("import_sites"), zero("importing_packages"))
        effort = scalars.effort(F.col("prize_bytes"), F.col("freed_bytes"), F.col("potential_bytes"), F.col("pinned_by") != "", F.col("import_sites"))
        return order.ranked(out.withColumn("effort", effort), order.named("candidates"))

    def entry_prizes(self) -> DataFrame:
        """module, pkg, retained of every target's entries, in order within each."""
        return entry.entry_weights(self.graph)

    def floor(self, selected: list[str] | None = None) -> DataFrame:
        return inspection.floor_of(self.graph, self.versions, selected).drop("graph_id")

    def measure(self) -> DataFrame:
        """binary_size, accounted_size, version, owned_max."""
        return self.size.select("binary_size", "accounted_size").crossJoin(self.floor().select("version", "owned_max"))

    def check(self, limits: budget.Budget, on_disk: bool = False) -> tuple[DataFrame, DataFrame]:
        """The broken rules and the verdict; on_disk holds the cap on size against the file as it is."""
        gated = self.size.select(F.col("binary_size" if on_disk else "accounted_size").alias("bytes"))
        held = anatomy.module_sizes(self.owned).select("module", "size").withColumn("in_build", F.lit(True))
        broken = stored(budget.violations(gated, self.floor(), held, limits, "on-disk binary" if on_disk else "stripped binary"))
        return broken, budget.verdict(broken, limits)

    def inspect(self, module: str) -> dict[str, DataFrame]:
        """summary, entries, sites, drags, why of one module."""
        sites = None
        if self.sources is not None:
            known = self.packages.filter("is_main").select("module").distinct().withColumn("dir", F.lit("."))
            sites = stored(imports.sites_of(self.sources, module, known))
        out = {"summary": inspection.inspect(self.graph, module, self.versions), "entries": inspection.entries(self.graph, module, sites), "drags": inspection.drags(self.graph, module)}
        if sites is not None:
            out["sites"] = sites.select("path", "line", "from_package", "import")
        out["why"] = session.import_why(self.graph, roots=[module])
        return out

    def diff(self, before: Analysis) -> dict[str, DataFrame]:
        """modules, totals, floor of the change from another build to this one."""
        own = lambda a: anatomy.module_sizes(a.owned).select("module", "size")
        changes = stored(reports.diff(own(before), own(self), self.main))
        direct = self.packages.filter("direct").select("module").distinct()
        return {"modules": changes, "totals": reports.diff_totals(changes, direct), "floor": reports.diff_floor(before.floor(), self.floor())}


def matrix(cells: dict[str, Analysis | Callable[[], Analysis]]) -> dict[str, DataFrame]:
    """modules, cells, floor, failed over the platforms.

    A cell may be a function that makes the analysis. One that can't be read has a row in failed(label,
    error), and the others count; if none is left, that is an error. What is reachable is found for all
    cells in one set of jobs, and so are their floors.
    """
    builds, versions, owned, failed = {}, None, None, []
    for label, cell in cells.items():
        try:
            a = cell() if callable(cell) else cell
            g = a.graph
            a.owned.limit(1).count()
        except Exception as e:  # whatever a cell's files do, the others are reported
            failed.append((label, (str(e).strip().splitlines() or [type(e).__name__])[0]))
            continue
        builds[label] = (g.packages, g.edges, g.roots)
        mine = a.packages.filter("module <> ''").select("module").distinct().select(F.lit(label).alias("label"), "module", ((F.col("module") == a.main) | matches(F.col("module"), a.policy.controlled)).alias("owned"))
        owned = mine if owned is None else owned.unionByName(mine)
        versions = a.versions.withColumn("label", F.lit(label)) if versions is None else versions.unionByName(a.versions.withColumn("label", F.lit(label)))
    if not builds:
        raise ValueError("no platform was built" + "".join(f"; {label}: {why}" for label, why in failed))
    spark = next(iter(builds.values()))[0].sparkSession
    sizes = stored(together(builds).filter("module <> ''"))
    named = sizes.select("label", "module").distinct().join(owned, ["label", "module"]).join(versions, ["label", "module"], "left")
    floors = reports.floor(named.select("label", "module", F.coalesce("version", F.lit("")).alias("version"), "owned"), "label")
    every = spark.createDataFrame([(label,) for label in builds], "label string")  # a cell of the standard library alone has no modules
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    floors = stored(every.join(floors, "label", "left").select("label", *map(blank, ("version", "critical", "next_version", "owned_max"))))
    first = versions.groupBy("module").agg(F.max("version").alias("version"))
    own = sizes.groupBy("label").agg(F.count_distinct("module").alias("modules"), F.sum("size").alias("bytes"))
    cells_ = every.join(own, "label", "left").select("label", F.coalesce("modules", F.lit(0)).alias("modules"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    pins = reports.worst_floor(floors, "label")
    return {"modules": order.ranked(reports.matrix_rows(sizes, first), order.named("matrix")), "cells": cells_.join(pins, "label"), "floor": reports.worst(floors), "failed": spark.createDataFrame(failed, "label string, error string")}
