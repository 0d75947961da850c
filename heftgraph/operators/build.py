"""What no policy changes about a build: packages, links and what is reachable, written once for all graphs over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.operators import kernel
from heftgraph.operators.kernel import WORD, Sweeper
from heftgraph.operators.reach import FRONT, HUB, reach_bits
from heftgraph.operators.storage import stands, stored


@dataclass
class Build:
    """packages(pkg, module, size), edges(src, dst), roots(pkg); module '' is the standard library.

    Names that only edges or roots have are packages without a module ('') and of size 0; a null
    size counts as 0 and a null module as ''.
    """

    packages: DataFrame
    edges: DataFrame
    roots: DataFrame
    #: False: always by frontier joins.
    small: bool = True

    def stands(self) -> bool:
        """Whether what has been stored of the build is still there."""
        return all(stands(self.__dict__[name]) for name in ("_arcs", "numbered", "links", "pairs", "base") if name in self.__dict__)

    @cached_property
    def _arcs(self) -> DataFrame:
        """src, dst of every edge, once."""
        return stored(self.edges.select("src", "dst").repartition(_dealt(self.edges.sparkSession), "dst").distinct())

    @cached_property
    def numbered(self) -> DataFrame:
        """pkg, module, size, id of every name; an id is odd if HUB edges or more start at the package."""
        listed = self.packages.select("pkg", F.coalesce("module", F.lit("")).alias("module"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.lit(1).alias("listed"), F.lit(0).cast("long").alias("out"))
        other = lambda d: d.select("pkg", F.lit("").alias("module"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("listed"), "out")
        # counted apart, so that what is met with packages is a row a name
        out = self._arcs.groupBy(F.col("src").alias("pkg")).agg(F.count("*").alias("out"))
        into = self._arcs.select(F.col("dst").alias("pkg")).distinct().withColumn("out", F.lit(0).cast("long"))
        start = self.roots.select("pkg", F.lit(0).cast("long").alias("out"))
        every = listed.union(other(out)).union(other(into)).union(other(start)).groupBy("pkg").agg(F.max(F.struct("listed", "module", "size")).alias("x"), F.max("out").alias("out"))
        return stored(every.select("pkg", "x.module", "x.size", (F.monotonically_increasing_id() * 2 + (F.col("out") >= HUB).cast("long")).alias("id")))

    @cached_property
    def nodes(self) -> DataFrame:
        """pkg, module, size of every name."""
        return self.numbered.select("pkg", "module", "size")

    @cached_property
    def links(self) -> DataFrame:
        """src, dst of every edge, once, with their modules sm and dm and ids s and d; hub is 1 where src is one, stored apart."""
        own = self.numbered.select("pkg", "module", "id")
        source = own.withColumnsRenamed({"pkg": "src", "module": "sm", "id": "s"})
        hubs = source.filter("s % 2 = 1")
        if hubs.count() <= FRONT:
            # most edges start at few packages, whose names are sent
            few = F.broadcast(hubs)
            found = self._arcs.join(few, "src").unionByName(self._arcs.join(few, "src", "left_anti").join(source.filter("s % 2 = 0"), "src"))
        else:
            found = self._arcs.join(source, "src")
        found = found.join(own.withColumnsRenamed({"pkg": "dst", "module": "dm", "id": "d"}), "dst")
        return stored(found.select("src", "dst", "sm", "dm", "s", "d", F.expr("cast(s % 2 as int)").alias("hub")), "hub")

    @cached_property
    def starts(self) -> DataFrame:
        """node: the ids of the roots."""
        return self.numbered.join(self.roots.select("pkg").distinct(), "pkg", "left_semi").select(F.col("id").alias("node"))

    @cached_property
    def pairs(self) -> DataFrame:
        """sm, dm of different modules, the second one not the standard library, that an edge joins."""
        return stored(self.links.filter("dm <> '' and dm <> sm").select("sm", "dm").distinct())

    @cached_property
    def _sent(self) -> tuple[Sweeper, object] | None:
        found = kernel.build(self.nodes, self.links, self.roots) if self.small else None
        return (found, self.roots.sparkSession.sparkContext.broadcast(found)) if found else None

    def kernel(self, classes: DataFrame) -> kernel.Kernel | None:
        """The build as the tasks share it, under the policy of classes, where it is within the kernel's bounds."""
        return kernel.Kernel(*self._sent, classes) if self._sent else None

    @cached_property
    def base(self) -> DataFrame:
        """Reachable packages with module and size."""
        if self._sent:
            sent = self._sent[1]

            def run(batches):
                for batch in batches:
                    for _ in range(batch.num_rows):
                        s = sent.value
                        yield s.rows(s.base, "")

            one = self.roots.sparkSession.createDataFrame([(0,)], "one int").coalesce(1)
            return stored(one.mapInArrow(run, "cut_id string, pkg string, module string, size long").select("pkg", "module", "size"))
        starts = self.starts.select("node", F.lit(0).alias("word"), F.lit(1).cast("long").alias("bits"))
        found = reach_bits(self.links.select(F.col("s").alias("src"), F.col("d").alias("dst"), "hub"), starts)
        return stored(self.numbered.join(found.select(F.col("node").alias("id")), "id", "left_semi").select("pkg", "module", "size"))


#: Between the label of a build and a name in it.
MARK = "\x01"


def _dealt(spark) -> int:
    """Parts for edges that are dealt out before they are compared, since hardly any repeats; as many as are asked for, which Spark doesn't merge."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def together(builds: dict[str, tuple[DataFrame, DataFrame, DataFrame]], small: bool = True) -> DataFrame:
    """label, pkg, module, size of what is reachable in each of several builds (packages, edges, roots), in one set of jobs.

    Builds are the bits of a word: an edge or a name that several have is kept once, with the bits of
    those that have it, and one walk follows it for all. Where the kernel takes all of them, they become
    one build whose names carry their labels, so no edge leads from one to another.
    """
    if not builds:
        raise ValueError("no build")
    for label in builds:
        if MARK in label:
            raise ValueError(f"a label with a control character: {label!r}")
    named = list(builds.items())
    out = None
    for at in range(0, len(named), WORD):
        found = _walked(named[at : at + WORD], small)
        out = found if out is None else out.unionByName(found)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


def _walked(builds: list[tuple[str, tuple[DataFrame, DataFrame, DataFrame]]], small: bool) -> DataFrame:
    """together() of at most WORD builds."""
    bit = lambda k: F.expr(f"shiftleft(1L, {k})").alias("mask")
    every = _union([edges.select("src", "dst", bit(k)) for k, (_, (_, edges, _)) in enumerate(builds)])
    spark = every.sparkSession
    arcs = stored(every.repartition(_dealt(spark), "dst").groupBy("src", "dst").agg(F.expr("bit_or(mask)").alias("mask")))
    if small and arcs.agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).alias("n")).first()["n"] <= kernel.EDGES:
        return _labelled(builds, arcs, small)
    roots = _union([roots.select("pkg", bit(k)) for k, (_, (_, _, roots)) in enumerate(builds)])
    degree = arcs.groupBy(F.col("src").alias("pkg")).agg(F.count("*").alias("out"))
    none = F.lit(0).cast("long").alias("out")
    names = degree.unionByName(arcs.select(F.col("dst").alias("pkg")).distinct().select("pkg", none)).unionByName(roots.select("pkg", none)).groupBy("pkg").agg(F.max("out").alias("out"))
    ids = stored(names.select("pkg", (F.monotonically_increasing_id() * 2 + (F.col("out") >= HUB).cast("long")).alias("id")))
    source = ids.withColumnsRenamed({"pkg": "src", "id": "s"})
    hubs = source.filter("s % 2 = 1")
    if hubs.count() <= FRONT:
        few = F.broadcast(hubs)
        met = arcs.join(few, "src").unionByName(arcs.join(few, "src", "left_anti").join(source.filter("s % 2 = 0"), "src"))
    else:
        met = arcs.join(source, "src")
    steps = met.select("s", "dst", "mask").join(ids.withColumnsRenamed({"pkg": "dst", "id": "d"}), "dst")
    steps = stored(steps.select(F.col("s").alias("src"), F.col("d").alias("dst"), "mask", F.expr("cast(s % 2 as int)").alias("hub")), "hub")
    starts = ids.join(roots, "pkg").select(F.col("id").alias("node"), F.lit(0).alias("word"), F.col("mask").alias("bits"))
    reached = reach_bits(steps, starts).select(F.col("node").alias("id"), "bits").join(ids, "id").select("pkg", "bits")
    own = F.filter(F.array(*(F.when(F.expr(f"bits & shiftleft(1L, {k}) <> 0"), F.lit(label)) for k, (label, _) in enumerate(builds))), lambda x: x.isNotNull())
    reached = reached.select(F.explode(own).alias("label"), "pkg")
    listed = _union([packages.select(F.lit(label).alias("label"), "pkg", F.coalesce("module", F.lit("")).alias("module"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")) for label, (packages, _, _) in builds])
    sizes = listed.groupBy("label", "pkg").agg(F.max(F.struct("module", "size")).alias("x"))
    return reached.join(sizes, ["label", "pkg"], "left").select("label", "pkg", F.coalesce("x.module", F.lit("")).alias("module"), F.coalesce("x.size", F.lit(0).cast("long")).alias("size"))


def _labelled(builds: list[tuple[str, tuple[DataFrame, DataFrame, DataFrame]]], arcs: DataFrame, small: bool) -> DataFrame:
    parts = []
    for k, (label, (packages, _, roots)) in enumerate(builds):
        named = lambda c, label=label: F.concat(F.lit(label + MARK), c).alias(c)
        parts.append((packages.select(named("pkg"), "module", F.col("size").cast("long").alias("size")), arcs.filter(F.expr(f"mask & shiftleft(1L, {k}) <> 0")).select(named("src"), named("dst")), roots.select(named("pkg"))))
    found = Build(*(_union([p[j] for p in parts]) for j in range(3)), small).base
    at = F.expr(f"locate('{MARK}', pkg)")
    return found.select(F.col("pkg").substr(F.lit(1), at - 1).alias("label"), F.expr(f"substring(pkg, locate('{MARK}', pkg) + 1)").alias("pkg"), "module", "size")
