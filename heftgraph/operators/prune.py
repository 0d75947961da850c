"""What leaves when modules are cut: exclusive bytes, prize, shared weight, plans and fair shares."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.operators.build import Build
from heftgraph.operators.entries import MOST_ENTRIES, Entries, entries
from heftgraph.operators.kernel import WORD, Kernel
from heftgraph.operators.policy import Policy, classify
from heftgraph.operators.reach import masks, numbered, reach, reach_bits
from heftgraph.operators.storage import stored

# Players up to which fair shares are exact (2**12 sweeps); sweeps, least and most orders of sampled ones; steps of a plan.
EXACT_PLAYERS = 12
SWEEPS, LEAST_ORDERS, MOST_ORDERS = 24_000, 64, 512
PLAN_STEPS = 25
#: Modules of a policy's frontier whose names the driver may hold, counted before.
MOST_TARGETS = 100_000


@dataclass
class Graph:
    """A build under a policy: packages(pkg, module, size), edges(src, dst), roots(pkg) as in Build.

    What the policy doesn't change is the build's, which other graphs may share; what it does is made
    here. The policy of a graph doesn't change: reclassified() gives another graph.
    """

    packages: DataFrame
    edges: DataFrame
    roots: DataFrame
    main: str
    policy: Policy
    #: False: always by frontier joins.
    small: bool = True
    build: Build | None = None

    def __post_init__(self):
        if self.build is None:
            self.build = Build(self.packages, self.edges, self.roots, self.small)

    @classmethod
    def over(cls, build: Build, main: str, policy: Policy) -> Graph:
        return cls(build.packages, build.edges, build.roots, main, policy, build.small, build)

    def reclassified(self, policy: Policy) -> Graph:
        """The same build under another policy; nodes, links and what is reachable are not made anew."""
        return Graph.over(self.build, self.main, policy)

    @property
    def nodes(self) -> DataFrame:
        """pkg, module, size of every name."""
        return self.build.nodes

    @property
    def base(self) -> DataFrame:
        """Reachable packages with module and size."""
        return self.build.base

    @cached_property
    def classes(self) -> DataFrame:
        return stored(classify(self.nodes, self.build.pairs, self.main, self.policy))

    @cached_property
    def targets(self) -> DataFrame:
        return self.classes.filter("target").select(F.col("module").alias("target"))

    def target_names(self) -> list[str]:
        """The targets in order of their names."""
        got = self.targets.orderBy("target").limit(MOST_TARGETS + 1).collect()
        if len(got) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        return [r[0] for r in got]

    @cached_property
    def hops(self) -> DataFrame:
        """edges with their modules sm, dm, ids s, d, hub, and the target that a cut severs them for."""
        # one row a module; Spark broadcasts it if its files are small
        cls = self.classes.select("module", "controlled", "target")
        out = self.build.links.join(cls.filter("controlled").select(F.col("module").alias("sm"), F.col("controlled").alias("sc")), "sm", "left").join(cls.filter("target").select(F.col("module").alias("dm"), F.col("target").alias("dt")), "dm", "left")
        return out.select("src", "dst", "sm", "dm", "s", "d", "hub", F.when(F.col("sc") & F.col("dt"), F.col("dm")).alias("cut_target"))

    @cached_property
    def _cut_arcs(self) -> DataFrame:
        """s, d, hub, cut_target of hops, as the walks read them."""
        return stored(self.hops.select("s", "d", "cut_target", "hub"), "hub")

    @cached_property
    def _prize_arcs(self) -> DataFrame:
        """_cut_arcs where cut_target is the module of an edge that comes from outside of it."""
        return self.build.links.select("s", "d", F.when(F.col("sm") != F.col("dm"), F.col("dm")).alias("cut_target"), "hub")

    @cached_property
    def kernel(self) -> Kernel | None:
        """The graph as the tasks share it, where it is within the kernel's bounds."""
        return self.build.kernel(self.classes)

    def _cuts(self, severed: DataFrame) -> DataFrame:
        """cut_id, targets; a null target keeps a cut that severs nothing."""
        spread = severed.sparkSession.sparkContext.defaultParallelism
        return severed.groupBy("cut_id").agg(F.collect_set("target").alias("targets")).repartition(spread, "cut_id")

    def reached(self, severed: DataFrame, starts: DataFrame | None = None) -> DataFrame:
        """(cut_id, pkg, module, size) reached in each cut of severed(cut_id, target), from the roots or from starts(cut_id, node)."""
        if self.kernel:
            cuts = self._cuts(severed)
            if starts is None:
                return self.kernel.reached(cuts.withColumn("starts", F.lit(None).cast("array<string>")))
            return self.kernel.reached(cuts.join(starts.groupBy("cut_id").agg(F.collect_set("node").alias("starts")), "cut_id"))
        every = severed.select("cut_id").distinct()
        if starts is None:
            starts = every.crossJoin(self.build.starts)
        else:
            starts = starts.join(self.build.numbered.select(F.col("pkg").alias("node"), "id"), "node").select("cut_id", F.col("id").alias("node"))
        found = reach(self.walked("cut"), starts, severed.filter("target is not null")).withColumnRenamed("node", "id")
        return found.join(self.build.numbered, "id").select("cut_id", "pkg", "module", "size")

    def walked(self, kind: str) -> DataFrame:
        """src, dst, hub, cut_target by ids."""
        arcs = self._cut_arcs if kind == "cut" else self._prize_arcs
        return arcs.withColumnsRenamed({"s": "src", "d": "dst"})

    def _by_roots(self, severed: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
        """The cuts, numbered, and (pkg, word, bits): the cuts in which a package is reached from the roots."""
        cuts = numbered(severed)
        starts = self.build.starts.crossJoin(cuts.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")))
        found = reach_bits(self.walked(kind), starts, masks(severed, cuts)).withColumnRenamed("node", "id")
        return cuts, found.join(self.build.numbered.select("pkg", "id"), "id").select("pkg", "word", "bits")

    @cached_property
    def single_cuts(self) -> DataFrame:
        return self.targets.select(F.col("target").alias("cut_id"), "target")

    def leaving(self, severed: DataFrame, kind: str = "cut") -> DataFrame:
        """(cut_id, pkg, module, size) of what each cut makes unreachable; of kind 'prize' all edges into a target from outside are severed."""
        if self.kernel:
            return self.kernel.leaving(self._cuts(severed), kind)
        if kind == "cut" and self.entries:
            return self.entries.leaving(self._cuts(severed))
        cuts, kept = self._by_roots(severed, kind)
        # a package and word that no cut of the word reaches has no row
        every = self.base.crossJoin(F.broadcast(cuts.groupBy("word").agg(F.expr("bit_or(bit)").alias("mask"))))
        gone = every.join(kept, ["pkg", "word"], "left").withColumn("gone", F.expr("mask & ~coalesce(bits, 0L)")).filter("gone <> 0")
        return gone.join(F.broadcast(cuts.select("cut_id", "word", "bit")), "word").filter("gone & bit <> 0").select("cut_id", "pkg", "module", "size")

    @cached_property
    def entries(self) -> Entries | None:
        """The entries of the targets, where there are few enough and the graph is beyond the kernel."""
        return None if self.kernel else entries(self._cut_arcs, self.base, self.build.starts, self.build.numbered, MOST_ENTRIES)

    @cached_property
    def prize_entries(self) -> Entries | None:
        """The same of the edges into targets from outside; where these are the edges that cuts sever, the same walk."""
        if self.kernel:
            return None
        outer = self.hops.withColumn("outer", F.when(F.col("sm") != F.col("dm"), F.col("dm"))).join(F.broadcast(self.targets.withColumnRenamed("target", "outer")), "outer", "left_semi")
        cut, outer = (stored(d) for d in (self._cut_arcs.filter("cut_target is not null").select("s", "d"), outer.select("s", "d", F.col("outer").alias("cut_target"))))
        if cut.count() == outer.count() and outer.join(cut, ["s", "d"], "left_anti").isEmpty():
            return self.entries
        own = self.targets.withColumnRenamed("target", "cut_target").withColumn("hit", F.lit(True))
        arcs = stored(self._prize_arcs.join(F.broadcast(own), "cut_target", "left").select("s", "d", F.when(F.col("hit"), F.col("cut_target")).alias("cut_target"), "hub"), "hub")
        return entries(arcs, self.base, self.build.starts, self.build.numbered, MOST_ENTRIES)

    def freed_sums(self, severed: DataFrame, *by) -> DataFrame:
        """cut_id, *by, bytes of what each cut frees, by columns over pkg and module; only what leaves has rows."""
        if self.entries:
            return self.entries.freed(self._cuts(severed), *by).drop("packages")
        return self.leaving(severed).groupBy("cut_id", *by).agg(F.sum("size").alias("bytes"))

    def freed_by(self, severed: DataFrame, kind: str = "cut", only_targets: bool = False) -> DataFrame:
        """cut_id, bytes, packages of what each cut frees; only_targets: cuts of kind 'prize' sever targets alone."""
        if self.kernel:
            return self.kernel.freed(self._cuts(severed), kind)
        known = None if kind == "prize" and not only_targets else self.entries if kind == "cut" else self.prize_entries
        if known:
            every = severed.select(F.col("cut_id").cast("string").alias("cut_id")).distinct()
            zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
            return every.join(known.freed(self._cuts(severed)), "cut_id", "left").select("cut_id", zero("bytes"), zero("packages"))
        # what is reached lies within the base, so sums by cut tell the rest
        cuts, kept = self._by_roots(severed, kind)
        sums = cuts.join(self._bit_sums(kept.join(self.nodes, "pkg")), "word", "left").selectExpr("cut_id", "coalesce(b[k], 0L) as b", "coalesce(n[k], 0L) as n")
        total = self.base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("packages"))
        return sums.crossJoin(total).select("cut_id", (F.col("bytes") - F.col("b")).alias("bytes"), (F.col("packages") - F.col("n")).alias("packages"))

    @cached_property
    def exclusive(self) -> DataFrame:
        """(cut_id = target, pkg, module, size) that leave with one target alone."""
        return stored(self.leaving(self.single_cuts))

    @cached_property
    def _freed_alone(self) -> DataFrame:
        return stored(self.freed_by(self.single_cuts))

    @cached_property
    def _prizes(self) -> DataFrame:
        return stored(self.freed_by(self.single_cuts, "prize", True))

    def exclusive_freed(self) -> DataFrame:
        """module, freed_bytes, freed_packages of every target."""
        return self._freed_alone.select(F.col("cut_id").alias("module"), F.col("bytes").alias("freed_bytes"), F.col("packages").alias("freed_packages"))

    def prize(self) -> DataFrame:
        """module, prize_bytes: what leaves if nothing outside a target imported it."""
        return self._prizes.select(F.col("cut_id").alias("module"), F.col("bytes").alias("prize_bytes"))

    @cached_property
    def words(self) -> DataFrame:
        """word, targets: all targets in order of their names, WORD at a time; bit k of a word is its k-th target."""
        names = self.target_names()
        rows = [(i // WORD, names[i : i + WORD]) for i in range(0, len(names), WORD)]
        return stored(self.roots.sparkSession.createDataFrame(rows, "word int, targets array<string>"))

    @cached_property
    def closure_bits(self) -> DataFrame:
        """pkg, word, bits: the targets from any package of which a package is reached, without cuts; one row a package and word."""
        if self.kernel:
            return stored(self.kernel.closures(self.words))
        bit = self._bits().withColumnsRenamed({"target": "module", "bit": "bits"})
        starts = self.build.numbered.join(bit, "module").select(F.col("id").alias("node"), "word", "bits")
        found = reach_bits(self.build.links.select(F.col("s").alias("src"), F.col("d").alias("dst"), "hub"), starts)
        return stored(found.withColumnRenamed("node", "id").join(self.build.numbered.select("pkg", "id"), "id").select("pkg", "word", "bits"))

    def _bits(self) -> DataFrame:
        """target, word, bit of every target."""
        return self.words.select("word", F.posexplode("targets").alias("k", "target")).select("target", "word", F.expr("shiftleft(1L, k)").alias("bit"))

    def _named(self, bits: DataFrame) -> DataFrame:
        """bits(word, bits, ...) with a row for each target whose bit is set, as target."""
        out = bits.join(F.broadcast(self.words), "word")  # at most MOST_TARGETS names
        kept = [c for c in bits.columns if c not in ("word", "bits")]
        return out.select(*kept, F.explode(F.expr("filter(transform(targets, (t, k) -> if(bits & shiftleft(1L, k) <> 0, t, null)), t -> t is not null)")).alias("target"))

    @cached_property
    def closures(self) -> DataFrame:
        """(target, pkg) reachable from any package of a target, without cuts."""
        return self._named(self.closure_bits).select("target", "pkg")

    def closure_counts(self) -> DataFrame:
        """target, packages, bytes of every target's closure."""
        return self._per_target(self.closure_bits.join(self.nodes, "pkg"))

    def _bit_sums(self, bits: DataFrame) -> DataFrame:
        """word, n, b: how many rows of bits(word, bits, size) have each bit, and the sums of their sizes."""
        has = [F.expr(f"bits & shiftleft(1L, {k}) <> 0") for k in range(WORD)]
        return bits.groupBy("word").agg(F.array(*(F.count_if(h) for h in has)).alias("n"), F.array(*(F.coalesce(F.sum(F.when(h, F.col("size"))), F.lit(0)) for h in has)).alias("b"))

    def _per_target(self, bits: DataFrame) -> DataFrame:
        """target, packages, bytes over bits(word, bits, size): sums a bit, without a row a target and package."""
        sums = self._bit_sums(bits)
        out = F.broadcast(self.words).join(sums, "word", "left")
        at = F.explode(F.expr("transform(targets, (t, k) -> struct(t as target, coalesce(n[k], 0L) as packages, coalesce(b[k], 0L) as bytes))"))
        return out.select(at.alias("x")).select("x.*")

    @cached_property
    def held(self) -> DataFrame:
        """pkg, module, size, word, bits: packages that only targets hold, with the targets whose closures have them."""
        every = self.targets.select(F.lit("all").alias("cut_id"), "target")
        freeable = self.leaving(every).select("pkg", "module", "size")
        return stored(freeable.join(self.closure_bits, "pkg"))

    @cached_property
    def blockers(self) -> DataFrame:
        """(pkg, module, size, target): packages that only targets hold, with each target whose closure has them."""
        return self._named(self.held)

    def potential(self) -> DataFrame:
        """module, potential_bytes, shared_bytes of every target."""
        p = self._per_target(self.held).select("target", F.col("bytes").alias("p"))
        return self.exclusive_freed().join(p, F.col("module") == F.col("target"), "left").select("module", F.coalesce("p", F.lit(0)).alias("potential_bytes"), (F.coalesce("p", F.lit(0)) - F.col("freed_bytes")).alias("shared_bytes"))

    def shared_with(self) -> DataFrame:
        """module, holder, bytes, also_via: weight of a target's closure that others hold too."""
        bit = self._bits().withColumnRenamed("target", "cut_id")
        alone = self.exclusive.join(bit, "cut_id").groupBy("pkg", "word").agg(F.expr("bit_or(bit)").alias("alone"))
        mine = self.held.join(alone, ["pkg", "word"], "left").withColumn("own", F.expr("bits & ~coalesce(alone, 0L)"))
        # packages of a holder that the same targets have go together
        sets = F.array_sort(F.collect_list(F.struct("word", "bits", "own")))
        holder = F.when(F.col("module") == "", "std").otherwise(F.col("module")).alias("holder")
        alike = mine.groupBy("pkg", "module", "size").agg(sets.alias("sets")).groupBy(holder, "sets").agg(F.sum("size").alias("bytes"))
        each = stored(alike.select("holder", "sets", "bytes", F.explode("sets").alias("x")).select("holder", "sets", "bytes", F.col("x.word").alias("word"), F.col("x.own").alias("bits")))
        shared = self._named(each)
        size = shared.groupBy("target", "holder").agg(F.sum("bytes").alias("bytes")).filter("bytes > 0")
        via = shared.select("target", "holder", F.explode("sets").alias("x")).groupBy("target", "holder", F.col("x.word").alias("word")).agg(F.expr("bit_or(x.bits)").alias("bits"))
        via = self._named(via.withColumnRenamed("target", "module")).filter("target <> module").groupBy("module", "holder").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("also_via"))
        return size.withColumnRenamed("target", "module").join(via, ["module", "holder"], "left").select("module", "holder", "bytes", F.coalesce("also_via", F.lit("")).alias("also_via"))

    def freed_modules(self) -> DataFrame:
        """module (target), freed_module: modules that leave with all their reachable packages."""
        total = self.base.filter("module <> ''").groupBy("module").agg(F.count("*").alias("n"))
        gone = self.exclusive.filter("module <> ''").groupBy("cut_id", "module").agg(F.count("*").alias("n"))
        return gone.join(total, ["module", "n"]).select(F.col("cut_id").alias("module"), F.col("module").alias("freed_module"))

    def pinned_by(self) -> DataFrame:
        """module, pinned_by: locked, uncontrolled modules that import a target directly."""
        pins = self.classes.filter("locked and not controlled").select(F.col("module").alias("sm"))
        hit = self.hops.filter("sm <> '' and dm <> '' and sm <> dm").join(pins, "sm", "left_semi").join(self.targets, F.col("dm") == F.col("target"), "left_semi")
        return hit.groupBy("dm").agg(F.array_join(F.array_sort(F.collect_set("sm")), ",").alias("pinned_by")).select(F.col("dm").alias("module"), "pinned_by")

    def candidates(self) -> DataFrame:
        """The prune table: freed, potential, shared, prize and pins of every target."""
        out = self.exclusive_freed().join(self.potential(), "module").join(self.prize(), "module").join(self.pinned_by(), "module", "left")
        return out.withColumn("pinned_by", F.coalesce("pinned_by", F.lit("")))

    def freed_breakdown(self) -> DataFrame:
        """module (target), unit, is_std, bytes: by module, or by package for the standard library."""
        std = F.col("module") == ""
        by = F.when(std, F.col("pkg")).otherwise(F.col("module")).alias("unit"), std.alias("is_std")
        return self.freed_sums(self.single_cuts, *by).select(F.col("cut_id").alias("module"), "unit", "is_std", "bytes")

    def fan_in(self) -> DataFrame:
        """module, importers: distinct importing modules within what is reachable; the standard library counts as one."""
        live = self.base.select("pkg")
        hop = self.hops.join(live.withColumnRenamed("pkg", "src"), "src", "left_semi").join(live.withColumnRenamed("pkg", "dst"), "dst", "left_semi")
        return hop.filter("dm <> '' and sm <> dm").groupBy(F.col("dm").alias("module")).agg(F.count_distinct("sm").alias("importers"))

    def plan(self, steps: int = PLAN_STEPS) -> DataFrame:
        """step, module, marginal, cumulative: each step takes the target that adds most, ties by name."""
        spark = self.roots.sparkSession
        names = self.target_names()
        chosen: list[str] = []
        rows, total = [], 0
        while len(chosen) < min(steps, len(names)):
            left = [(n,) for n in names if n not in chosen]
            held = F.array(*map(F.lit, chosen)).cast("array<string>")
            # every remaining target with those chosen so far, in one job
            cuts = spark.createDataFrame(left, "cut_id string").select("cut_id", F.explode(F.concat(held, F.array("cut_id"))).alias("target"))
            best = self.freed_by(cuts).orderBy(F.desc("bytes"), "cut_id").first()
            if best["bytes"] <= total:
                break
            rows.append((len(rows) + 1, best["cut_id"], best["bytes"] - total, best["bytes"]))
            total = best["bytes"]
            chosen.append(best["cut_id"])
        return spark.createDataFrame(rows, "step int, module string, marginal long, cumulative long")

    def plan_steps(self, steps: int = PLAN_STEPS) -> DataFrame:
        """plan() with the bytes of the step's own module that leave, its share in percent, and the module's importers."""
        plan = stored(self.plan(steps))
        chosen = [r["module"] for r in plan.orderBy("step").collect()]
        spark = self.roots.sparkSession
        cuts = spark.createDataFrame([(str(k), t) for k in range(1, len(chosen) + 1) for t in chosen[:k]], "cut_id string, target string")
        gone = self.freed_sums(cuts, "module").select(F.col("cut_id").cast("int").alias("step"), "module", "bytes")
        before = gone.select((F.col("step") + 1).alias("step"), "module", F.col("bytes").alias("was"))
        own = plan.select("step", "module").join(gone, ["step", "module"], "left").join(before, ["step", "module"], "left").select("step", (F.coalesce("bytes", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("own_bytes"))
        return plan.join(own, "step").join(self.fan_in(), "module", "left").select("step", "module", "marginal", "cumulative", "own_bytes", F.coalesce("importers", F.lit(0)).alias("importers"))

    def shapley(self) -> DataFrame:
        """module, blame, alone, exact: fair share of each target in what all targets free together."""
        spark = self.roots.sparkSession
        names = self.target_names()
        n = len(names)
        if not n:
            return spark.createDataFrame([], "module string, blame long, alone long, exact boolean")
        if n > EXACT_PLAYERS:
            return self._sampled(names)
        masks = spark.range(1 << n).select(F.col("id").cast("int").alias("mask"))
        players = spark.createDataFrame(list(enumerate(names)), "i int, module string")
        listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(names)))
        members = F.expr("transform(filter(listed, p -> mask & shiftleft(1, p.i) <> 0), p -> p.t)")
        cuts = masks.withColumn("listed", listed).select(F.col("mask").cast("string").alias("cut_id"), F.explode_outer(members).alias("target"))
        value = stored(self.freed_by(cuts).select(F.col("cut_id").cast("int").alias("mask"), F.col("bytes").cast("decimal(38,0)").alias("v")))
        weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - s - 1)) for s in range(n)]), F.bit_count("mask") + 1)
        # 2**12 masks at most, and 12 players
        without = value.crossJoin(F.broadcast(players)).filter("mask & shiftleft(1, i) = 0").withColumn("other", F.expr("mask | shiftleft(1, i)"))
        gain = without.join(F.broadcast(value.select(F.col("mask").alias("other"), F.col("v").alias("w"))), "other")
        share = gain.groupBy("module").agg(F.sum((F.col("w") - F.col("v")) * weight).alias("num"), F.max(F.when(F.col("mask") == 0, F.col("w"))).alias("alone"))
        blame = F.expr(f"cast((2 * num + {factorial(n)}) div {2 * factorial(n)} as long)")
        return share.select("module", F.greatest(blame, F.lit(0)).alias("blame"), F.col("alone").cast("long").alias("alone"), F.lit(True).alias("exact"))

    def _sampled(self, names: list[str]) -> DataFrame:
        """Mean gains along random orders of the targets; only the orders are sent, gains telescope within the tasks."""
        import numpy as np

        spark, n = self.roots.sparkSession, len(names)
        samples = min(max(SWEEPS // n, LEAST_ORDERS), MOST_ORDERS)
        rng = np.random.default_rng(1)
        order = [(s, [names[i] for i in rng.permutation(n).tolist()]) for s in range(samples)]
        orders = spark.createDataFrame(order, "sample int, targets array<string>").repartition(spark.sparkContext.defaultParallelism, "sample")
        gain = self.gains_along(orders)
        blame = F.greatest(F.expr(f"cast((2 * gain + {samples}) div {2 * samples} as long)"), F.lit(0))
        return gain.select("module", blame.alias("blame"), F.lit(None).cast("long").alias("alone"), F.lit(False).alias("exact"))

    def gains_along(self, orders: DataFrame) -> DataFrame:
        """module, gain: what each target frees beyond those before it, summed over orders(sample, targets)."""
        if self.kernel:
            return self.kernel.along(orders)
        spots = orders.select("sample", "targets", F.posexplode("targets").alias("p", "module"))
        value = self.freed_by(spots.select(F.concat_ws("/", "sample", "p").alias("cut_id"), F.explode(F.expr("slice(targets, 1, p + 1)")).alias("target")))
        step = spots.select("sample", "p", "module", F.concat_ws("/", "sample", "p").alias("cut_id")).join(value, "cut_id")
        return step.selectExpr("module", "bytes - lag(bytes, 1, 0L) over (partition by sample order by p) as d").groupBy("module").agg(F.sum("d").alias("gain"))

    def what_if(self, selected: list[str]) -> DataFrame:
        """original_size, freed_bytes, projected_size when the selected targets are cut."""
        spark = self.roots.sparkSession
        named = spark.createDataFrame([(s,) for s in selected], "target string").join(self.targets, "target", "left_semi")
        cut = named.select(F.lit("cut").alias("cut_id"), "target").union(spark.createDataFrame([("cut", None)], "cut_id string, target string"))
        freed = self.freed_by(cut).select(F.col("bytes").alias("freed_bytes"))
        whole = self.base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("original_size"))
        return whole.crossJoin(freed).select("original_size", "freed_bytes", F.greatest(F.col("original_size") - F.col("freed_bytes"), F.lit(0)).alias("projected_size"))

    def freed_list(self, selected: list[str]) -> DataFrame:
        """module, bytes, whole: what a selection frees of each module, and whether all of its reachable bytes (more than none) leave."""
        spark = self.roots.sparkSession
        cut = spark.createDataFrame([("cut", s) for s in selected] or [("cut", None)], "cut_id string, target string")
        gone = self.leaving(cut).groupBy("module").agg(F.sum("size").alias("bytes"))
        total = self.base.groupBy("module").agg(F.sum("size").alias("total"))
        return gone.join(total, "module").select("module", "bytes", ((F.col("total") > 0) & (F.col("bytes") >= F.col("total")) & (F.col("module") != "")).alias("whole"))
