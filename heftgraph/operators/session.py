"""Questions about single modules and selections: marginals, drag-out, co-prunes, why trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.operators.build import Build
from heftgraph.operators.policy import Policy
from heftgraph.operators.prune import Graph
from heftgraph.operators.storage import stored

# Nodes of a tree, and shown importers of each.
WHY_NODES, WHY_BREADTH = 8, 3
#: Module edges that may be broadcast for why trees, counted before.
WHY_EDGES = 1_000_000
RANK = {"main": 0, "1st": 1, "2nd": 2, "3rd": 3}


def _cuts(g: Graph, cuts: dict[str, list[str]]) -> DataFrame:
    rows = [(c, t) for c, members in cuts.items() for t in (members or [None])]
    return g.roots.sparkSession.createDataFrame(rows, "cut_id string, target string")


def marginals(g: Graph, selected: list[str]) -> DataFrame:
    """module, marginal: what cutting each target frees beyond the selection."""
    # the selection goes with every target; '' is the selection alone
    cuts = g.single_cuts.select("cut_id").union(_cuts(g, {"": []}).select("cut_id"))
    chosen = F.array(*map(F.lit, selected)).cast("array<string>")
    cuts = cuts.select("cut_id", F.explode_outer(F.when(F.col("cut_id") == "", chosen).otherwise(F.concat(chosen, F.array("cut_id")))).alias("target"))
    freed = stored(g.freed_by(cuts))
    return freed.filter("cut_id <> ''").crossJoin(freed.filter("cut_id = ''").select(F.col("bytes").alias("v"))).select(F.col("cut_id").alias("module"), (F.col("bytes") - F.col("v")).alias("marginal"))


def importers(g: Graph) -> DataFrame:
    """module, importer: distinct imports between modules within what is reachable, without the standard library."""
    live = g.base.select("pkg")
    hops = g.hops.filter("dm <> '' and sm <> '' and sm <> dm").join(live.withColumnRenamed("pkg", "src"), "src", "left_semi").join(live.withColumnRenamed("pkg", "dst"), "dst", "left_semi")
    return hops.select(F.col("dm").alias("module"), F.col("sm").alias("importer")).distinct()


def drag_out(g: Graph, module: str, selected: list[str] | None = None) -> DataFrame:
    """module, bytes, freed, needed_by: what a module pulls in, and who keeps it when the selection (the module itself, unless given) is cut."""
    spark = g.roots.sparkSession
    start = g.nodes.filter(F.col("module") == module).select(F.lit("m").alias("cut_id"), F.col("pkg").alias("node"))
    inside = g.reached(spark.createDataFrame([("m", None)], "cut_id string, target string"), start).select("pkg")
    deps = g.base.join(inside, "pkg", "left_semi").filter((F.col("module") != "") & (F.col("module") != module)).select("module").distinct()
    left = stored(g.reached(_cuts(g, {"m": [module] if selected is None else selected})).select("module").distinct())
    by = importers(g).filter(F.col("importer") != module).join(left.withColumnRenamed("module", "importer"), "importer", "left_semi")
    by = by.join(left, "module", "left_semi").groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("importer")), ",").alias("needed_by"))
    size = g.base.groupBy("module").agg(F.sum("size").alias("bytes"))
    here = deps.join(size, "module").join(left.withColumn("stays", F.lit(True)), "module", "left").join(by, "module", "left")
    return here.select("module", "bytes", F.col("stays").isNull().alias("freed"), F.coalesce("needed_by", F.lit("")).alias("needed_by"))


def plan_freed(g: Graph, plan: list[str]) -> DataFrame:
    """step, unit, bytes, co_prune: what each step of a plan frees more, and the earlier steps it needs for that."""
    cuts, pairs = {}, []
    for k, name in enumerate(plan, 1):
        cuts[f"p{k}"] = plan[:k]
        cuts[f"s{k}"] = [name]
        for j, other in enumerate(plan[: k - 1]):
            cuts[f"w{k}/{j}"] = plan[:j] + plan[j + 1 : k]
            pairs.append((k, f"w{k}/{j}", other))
    spark = g.roots.sparkSession
    unit = F.when(F.col("module") == "", F.col("pkg")).otherwise(F.col("module")).alias("unit")
    freed = stored(g.freed_sums(_cuts(g, cuts), unit))
    at = freed.filter("startswith(cut_id, 'p')").select(F.expr("cast(substring(cut_id, 2) as int)").alias("step"), "unit", "bytes")
    earlier = at.select((F.col("step") + 1).alias("step"), "unit", F.col("bytes").alias("was"))
    gain = at.join(earlier, ["step", "unit"], "left").withColumn("bytes", F.col("bytes") - F.coalesce("was", F.lit(0))).filter("bytes > 0").select("step", "unit", "bytes")
    alone = freed.filter("startswith(cut_id, 's')").select(F.expr("cast(substring(cut_id, 2) as int)").alias("step"), "unit")
    without = spark.createDataFrame(pairs, "step int, cut_id string, other string")
    need = gain.join(alone, ["step", "unit"], "left_anti").join(F.broadcast(without), "step").join(freed.select("cut_id", "unit"), ["cut_id", "unit"], "left_anti")
    need = need.groupBy("step", "unit").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("co_prune"))
    return gain.join(need, ["step", "unit"], "left").withColumn("co_prune", F.coalesce("co_prune", F.lit("")))


def import_why(g: Graph, nodes: int = WHY_NODES, breadth: int = WHY_BREADTH, roots: list[str] | None = None) -> DataFrame:
    """root, place, module, via (place of the node it hangs on), more: who imports each module (or these roots), up to code of one's own."""
    spark = g.roots.sparkSession
    edges = importers(g)
    if edges.limit(WHY_EDGES + 1).count() > WHY_EDGES:
        raise ValueError(f"more than {WHY_EDGES} module edges")
    known = g.classes.select("module", "class")
    rows = edges.join(known, edges["importer"] == known["module"]).select(edges["module"], "importer", "class").toPandas()
    by: dict[str, list[tuple[int, str]]] = {}
    for m, i, c in rows.itertuples(index=False):
        by.setdefault(m, []).append((RANK[c], i))
    for found in by.values():
        found.sort()
    sent = spark.sparkContext.broadcast(by)

    def run(frames):
        by = sent.value
        for frame in frames:
            out = []
            for root in frame["module"]:
                tree, seen = [[root, 9, -1, 0]], {root}
                for place, node in enumerate(tree):  # grows as it is walked
                    if place and node[1] <= RANK["1st"]:
                        continue
                    open_ = [x for x in by.get(node[0], ()) if x[1] not in seen]
                    taken = open_[: min(breadth, nodes - len(tree))]
                    node[3] = len(open_) - len(taken)
                    seen.update(m for _, m in taken)
                    tree.extend([m, r, place, 0] for r, m in taken)
                if len(tree) > 1:
                    out += [(root, p, m, via, more) for p, (m, _, via, more) in enumerate(tree)]
            yield pd.DataFrame(out, columns=["root", "place", "module", "via", "more"])

    asked = edges.select("module").distinct()
    return (asked if roots is None else asked.filter(F.col("module").isin(roots))).mapInPandas(run, "root string, place int, module string, via int, more int")


class Session:
    """A build that is asked again and again, under one policy after the other.

    What no policy changes (packages, links, what is reachable, versions, import sites) is made once and
    stays; reclassify() throws away only what the policy decides.
    """

    def __init__(self, build: Build, main: str, policy: Policy, versions: DataFrame | None = None, coupling: DataFrame | None = None):
        """versions(module, version) and coupling(module, import_sites, ...) may be missing."""
        spark = build.roots.sparkSession
        self.build = build
        self.versions = spark.createDataFrame([], "module string, version string") if versions is None else stored(versions)
        self.coupling = spark.createDataFrame([], "module string, import_sites long") if coupling is None else stored(coupling.select("module", "import_sites"))
        self.graph = Graph.over(build, main, policy)

    def reclassify(self, policy: Policy) -> None:
        """From now on the questions are asked under this policy."""
        self.graph = self.graph.reclassified(policy)

    def modules(self) -> DataFrame:
        """module, bytes, class, locked, target, version, exclusive_bytes, prize_bytes, importers, pinned_by, import_sites of every module that is reachable."""
        g = self.graph
        own = g.base.filter("module <> ''").groupBy("module").agg(F.sum("size").alias("bytes"))
        out = own.join(g.classes.select("module", "class", "locked", "target"), "module").join(self.versions, "module", "left").join(self.coupling, "module", "left")
        out = out.join(g.exclusive_freed().select("module", F.col("freed_bytes").alias("exclusive_bytes")), "module", "left").join(g.prize(), "module", "left").join(g.fan_in(), "module", "left").join(g.pinned_by(), "module", "left")
        zero, blank = (lambda c: F.coalesce(c, F.lit(0)).alias(c)), (lambda c: F.coalesce(c, F.lit("")).alias(c))
        return out.select("module", "bytes", "class", "locked", "target", blank("version"), zero("exclusive_bytes"), zero("prize_bytes"), zero("importers"), blank("pinned_by"), zero("import_sites"))

    def floor(self, selected: list[str] | None = None) -> DataFrame:
        """version, critical, next_version, owned_max of what is left when a selection is cut."""
        from heftgraph.operators import inspect

        return inspect.floor_of(self.graph, self.versions, selected).drop("graph_id")

    def freed(self, selected: list[str]) -> DataFrame:
        """module, bytes, whole: what a selection frees."""
        return self.graph.freed_list(selected)

    def drag(self, module: str, selected: list[str] | None = None) -> DataFrame:
        """module, bytes, freed, needed_by: what a module pulls in, and who keeps it."""
        return drag_out(self.graph, module, selected)

    def detail(self, module: str) -> dict[str, DataFrame]:
        """summary (its row of modules() with pulls_in), freed (what leaves with it), drags, importers and importees (direct ones), why (tree of importers) of one module."""
        g, m = self.graph, F.col("module") == module
        drags = stored(self.drag(module))
        kept = drags.filter("not freed").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("held"))
        summary = self.modules().filter(m).crossJoin(kept).withColumn("pulls_in", F.col("exclusive_bytes") + F.col("held")).drop("held")
        by = stored(importers(g))
        out = {"summary": summary, "drags": drags, "importers": by.filter(m).select(F.col("importer").alias("module")), "importees": by.filter(F.col("importer") == module).select("module")}
        out["freed"] = g.freed_list([module])
        out["why"] = import_why(g, roots=[module])
        return out
