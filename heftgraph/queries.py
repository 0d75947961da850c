"""Registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.functions import scalars as fn
from heftgraph.operators import reports, sizes
from heftgraph.operators.policy import Policy, matches
from heftgraph.plans import derived
from heftgraph.plans.derived import graph

LABEL = "concat(l_returnflag, '/', l_linestatus)"

_PKG = """
pkg AS (SELECT 'app/main' AS pkg, 'app' AS module, CAST(10 AS BIGINT) AS size
  UNION ALL SELECT 'region/' || r_regionkey, 'region/' || r_name, 100 FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'nation/' || n_name, 1000 FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || n_name, CAST(round(abs(s_acctbal) * 100) AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part/' || p_partkey, CASE WHEN p_size <= 5 THEN '' ELSE 'brand/' || p_brand END, CAST(round(p_retailprice * 100) AS BIGINT) FROM part),
edge AS (SELECT 'app/main' AS src, 'region/' || r_regionkey AS dst FROM region
  UNION SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey FROM nation
  UNION SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey FROM supplier
  UNION SELECT 'supplier/' || l_suppkey, 'part/' || l_partkey FROM lineitem WHERE {lines}
  UNION SELECT 'part/' || p_partkey, 'part/' || (p_partkey // 2) FROM part WHERE p_partkey >= 2),
hop AS (SELECT src, dst, s.module AS sm, d.module AS dm FROM edge JOIN pkg s ON src = s.pkg JOIN pkg d ON dst = d.pkg),
tgt AS (SELECT DISTINCT dm AS t FROM hop WHERE (sm = 'app' OR sm LIKE 'region/%') AND dm <> '' AND dm <> sm AND dm NOT LIKE 'region/%'),
ce AS (SELECT src, dst, sm, dm, CASE WHEN (sm = 'app' OR sm LIKE 'region/%') AND dm IN (SELECT t FROM tgt) THEN dm END AS ct FROM hop)"""


def _sql(body: str, lines: str = "true") -> str:
    return "WITH RECURSIVE " + _PKG.replace("{lines}", lines).strip() + ",\n" + body.strip()


_BASE = "base AS (SELECT 'app/main' AS node UNION SELECT dst FROM base JOIN ce ON node = src), live AS (SELECT pkg.* FROM pkg JOIN base ON pkg = node)"
_EXCL = _BASE + ", cutr AS (SELECT t, 'app/main' AS node FROM tgt UNION SELECT t, dst FROM cutr JOIN ce ON node = src AND ct IS DISTINCT FROM t), ex AS (SELECT tgt.t, live.* FROM tgt CROSS JOIN live WHERE NOT EXISTS (SELECT 1 FROM cutr WHERE cutr.t = tgt.t AND cutr.node = live.pkg))"
_FREED = "fr AS (SELECT tgt.t AS module, CAST(coalesce(sum(size), 0) AS BIGINT) AS freed_bytes, count(pkg) AS freed_packages FROM tgt LEFT JOIN ex ON tgt.t = ex.t GROUP BY 1)"
_PRIZE = "pzr AS (SELECT t, 'app/main' AS node FROM tgt UNION SELECT t, dst FROM pzr JOIN ce ON node = src AND NOT (dm = t AND sm <> t)), pz AS (SELECT tgt.t AS module, CAST(coalesce(sum(size), 0) AS BIGINT) AS prize_bytes FROM tgt CROSS JOIN live WHERE NOT EXISTS (SELECT 1 FROM pzr WHERE pzr.t = tgt.t AND pzr.node = live.pkg) GROUP BY 1)"
_CLOSE = "clo AS (SELECT t, pkg AS node FROM tgt JOIN pkg ON module = t UNION SELECT t, dst FROM clo JOIN ce ON node = src)"
_BLOCK = _CLOSE + ", keep AS (SELECT 'app/main' AS node UNION SELECT dst FROM keep JOIN ce ON node = src AND ct IS NULL), bl AS (SELECT clo.t, live.* FROM live JOIN clo ON pkg = node WHERE pkg NOT IN (SELECT node FROM keep))"
_POT = "pot AS (SELECT fr.module, CAST(coalesce(sum(size), 0) AS BIGINT) AS potential_bytes, CAST(coalesce(sum(size), 0) - any_value(freed_bytes) AS BIGINT) AS shared_bytes FROM fr LEFT JOIN bl ON fr.module = bl.t GROUP BY 1)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(_sql("SELECT (SELECT count(*) FROM pkg) AS packages, (SELECT count(*) FROM edge) AS edges, (SELECT count(DISTINCT module) FROM pkg WHERE module <> '') AS modules"))
def graph_counts(spark, sf):
    g = graph(spark, sf)
    return g.packages.agg(F.count("*").alias("packages"), F.count_distinct(F.when(F.col("module") != "", F.col("module"))).alias("modules")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


@query(_sql("SELECT DISTINCT module, CASE WHEN module = 'app' THEN 'main' WHEN module LIKE 'region/%' THEN '1st' WHEN module IN (SELECT t FROM tgt) THEN '2nd' ELSE '3rd' END AS class, (module = 'app' OR module LIKE 'region/%') AS controlled, (module = 'app' OR module LIKE 'region/%') AS locked, module IN (SELECT t FROM tgt) AS target, module IN (SELECT t FROM tgt) AS direct_imported FROM pkg WHERE module <> ''"))
def classify(spark, sf):
    return graph(spark, sf).classes


@query(_sql("SELECT DISTINCT module, (module = 'nation' OR module LIKE 'nation/%') AS below, module LIKE 'brand/Brand#1%' AS prefix, regexp_matches(module, '^brand/Brand#[12]$') AS glob FROM pkg WHERE module <> ''"))
def pattern_match(spark, sf):
    m = F.col("module")
    return derived.packages(spark, sf).filter("module <> ''").select("module").distinct().select("module", matches(m, ["nation/..."]).alias("below"), matches(m, ["brand/Brand#1..."]).alias("prefix"), matches(m, ["*/Brand#[12]"]).alias("glob"))


@query(_sql(_BASE + " SELECT pkg, module, size FROM live"))
def reachable_base(spark, sf):
    return graph(spark, sf).base.select("pkg", "module", "size")


@query(_sql(_CLOSE + " SELECT t AS target, count(*) AS packages FROM clo GROUP BY 1"))
def closure_per_module(spark, sf):
    return graph(spark, sf).closure_counts().select("target", "packages")


@query(_sql(_EXCL + ", " + _FREED + " SELECT * FROM fr"))
def exclusive_freed(spark, sf):
    return graph(spark, sf).exclusive_freed()


@query(_sql(_EXCL + " SELECT t AS target, pkg FROM ex"))
def exclusive_pkgs(spark, sf):
    return graph(spark, sf).exclusive.select(F.col("cut_id").alias("target"), "pkg")


@query(_sql(_EXCL + ", a AS (SELECT module, count(*) AS n FROM live WHERE module <> '' GROUP BY 1), b AS (SELECT t, module, count(*) AS n FROM ex WHERE module <> '' GROUP BY 1, 2) SELECT t AS module, b.module AS freed_module FROM b JOIN a ON a.module = b.module AND a.n = b.n"))
def freed_modules(spark, sf):
    return graph(spark, sf).freed_modules()


@query(_sql(_BASE + ", " + _PRIZE + " SELECT * FROM pz"))
def prize(spark, sf):
    return graph(spark, sf).prize()


@query(_sql(_BASE + ", " + _BLOCK + " SELECT pkg, t AS target FROM bl"))
def blockers(spark, sf):
    return graph(spark, sf).blockers.select("pkg", "target")


@query(_sql(_EXCL + ", " + _FREED + ", " + _BLOCK + ", " + _POT + " SELECT * FROM pot"))
def potential_shared(spark, sf):
    return graph(spark, sf).potential()


@query(_sql(_EXCL + ", " + _BLOCK + """, sh AS (SELECT t, pkg, size, CASE WHEN module = '' THEN 'std' ELSE module END AS holder FROM bl WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.t = bl.t AND ex.pkg = bl.pkg)),
sz AS (SELECT t, holder, CAST(sum(size) AS BIGINT) AS bytes FROM sh GROUP BY 1, 2 HAVING sum(size) > 0),
vi AS (SELECT sh.t, holder, string_agg(DISTINCT bl.t, ',' ORDER BY bl.t) AS also_via FROM sh JOIN bl ON sh.pkg = bl.pkg AND bl.t <> sh.t GROUP BY 1, 2)
SELECT sz.t AS module, sz.holder AS holder, bytes, coalesce(also_via, '') AS also_via FROM sz LEFT JOIN vi ON sz.t = vi.t AND sz.holder = vi.holder"""))
def shared_with(spark, sf):
    return graph(spark, sf).shared_with()


@query(_sql("SELECT dm AS module, string_agg(DISTINCT sm, ',' ORDER BY sm) AS pinned_by FROM hop WHERE sm LIKE 'nation/%' AND dm <> '' AND dm <> sm AND dm LIKE 'brand/%' GROUP BY 1"))
def pinned_by(spark, sf):
    """With brands controlled by a pattern that is unlocked again, and nations locked, nations pin brands."""
    policy = Policy(controlled=("region/...", "brand/..."), locked=("nation/...",), unlock=("brand/...",))
    g = graph(spark, sf, policy)
    return g.pinned_by()


_CAND = _EXCL + ", " + _FREED + ", " + _PRIZE + ", " + _BLOCK + ", " + _POT


@query(_sql(_CAND + " SELECT fr.module AS module, freed_bytes, freed_packages, potential_bytes, shared_bytes, prize_bytes, '' AS pinned_by FROM fr JOIN pot ON fr.module = pot.module JOIN pz ON fr.module = pz.module"))
def prune_candidates(spark, sf):
    return graph(spark, sf).candidates()


@query(_sql(_CAND + " SELECT fr.module AS module, CASE WHEN freed_bytes = 0 AND potential_bytes > 0 THEN 'coordinated' WHEN freed_bytes = 0 AND prize_bytes > 0 THEN 'pinnedByDep' WHEN freed_packages >= 20 THEN 'core' ELSE 'quickWin' END AS effort FROM fr JOIN pot ON fr.module = pot.module JOIN pz ON fr.module = pz.module"))
def effort(spark, sf):
    """The number of freed packages stands for import sites, which these tables don't have."""
    c = graph(spark, sf).candidates()
    return c.select("module", fn.effort(F.col("prize_bytes"), F.col("freed_bytes"), F.col("potential_bytes"), F.col("pinned_by") != "", F.col("freed_packages")).alias("effort"))


@query(_sql(_EXCL + " SELECT t AS module, CASE WHEN module = '' THEN pkg ELSE module END AS unit, module = '' AS is_std, CAST(sum(size) AS BIGINT) AS bytes FROM ex GROUP BY 1, 2, 3"))
def freed_breakdown(spark, sf):
    return graph(spark, sf).freed_breakdown()


@query(_sql(_BASE + " SELECT dm AS module, count(DISTINCT sm) AS importers FROM ce WHERE dm <> '' AND sm <> dm AND src IN (SELECT node FROM base) AND dst IN (SELECT node FROM base) GROUP BY 1"))
def importer_fan_in(spark, sf):
    return graph(spark, sf).fan_in()


@query(_sql(_BASE + " SELECT DISTINCT dm AS module, sm AS importer FROM ce WHERE dm <> '' AND sm <> '' AND sm <> dm AND src IN (SELECT node FROM base) AND dst IN (SELECT node FROM base)"))
def module_importers(spark, sf):
    g = graph(spark, sf)
    live = g.base.select("pkg")
    return g.hops.filter("dm <> '' and sm <> '' and sm <> dm").join(live.withColumnRenamed("pkg", "src"), "src", "left_semi").join(live.withColumnRenamed("pkg", "dst"), "dst", "left_semi").select(F.col("dm").alias("module"), F.col("sm").alias("importer")).distinct()


def _greedy_sql(steps: int) -> str:
    parts, before = [_BASE, "tot AS (SELECT sum(size) AS s FROM live)"], []
    for k in range(1, steps + 1):
        chosen = "".join(f" AND ct IS DISTINCT FROM (SELECT t FROM b{j})" for j in before)
        skip = "".join(f" AND t <> (SELECT t FROM b{j})" for j in before)
        parts.append(f"r{k} AS (SELECT t, 'app/main' AS node FROM tgt WHERE true{skip} UNION SELECT t, dst FROM r{k} JOIN ce ON node = src AND ct IS DISTINCT FROM t{chosen})")
        parts.append(f"f{k} AS MATERIALIZED (SELECT t, (SELECT s FROM tot) - sum(size) AS v FROM r{k} JOIN pkg ON node = pkg GROUP BY 1)")
        parts.append(f"b{k} AS MATERIALIZED (SELECT t, v FROM f{k} ORDER BY v DESC, t LIMIT 1)")
        before.append(k)
    rows = [f"SELECT CAST({k} AS INTEGER) AS step, t AS module, CAST(v - {f'(SELECT v FROM b{k - 1})' if k > 1 else 0} AS BIGINT) AS marginal, CAST(v AS BIGINT) AS cumulative FROM b{k}" for k in before]
    return ", ".join(parts) + " " + " UNION ALL ".join(rows)


@query(_sql(_greedy_sql(3)))
def greedy_plan_3(spark, sf):
    return graph(spark, sf).plan(3)


@query(_sql(_greedy_sql(25).replace(" SELECT CAST(1 AS INTEGER)", ", pl AS (SELECT CAST(1 AS INTEGER)", 1) + ") SELECT * FROM pl WHERE marginal > 0"))
def greedy_plan_full(spark, sf):
    return graph(spark, sf).plan()


def _five(spark, sf):
    names = [r[0] for r in derived.read(spark, sf, "nation").filter("n_regionkey <> 1").select("n_name").collect()]
    return graph(spark, sf, Policy(controlled=("region/...",), locked=tuple("nation/" + n for n in names)))


@query(_sql("""pl AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM tgt WHERE t IN (SELECT 'nation/' || n_name FROM nation WHERE n_regionkey = 1)),
n AS (SELECT count(*) AS n FROM pl), mk AS (SELECT CAST(range AS INTEGER) AS mask FROM range(32)),
rr AS (SELECT mask, 'app/main' AS node FROM mk UNION SELECT mask, dst FROM rr JOIN ce ON node = src LEFT JOIN pl ON ct = pl.t WHERE pl.i IS NULL OR (mask >> CAST(pl.i AS INTEGER)) & 1 = 0),
kept AS (SELECT mask, sum(size) AS s FROM rr JOIN pkg ON node = pkg GROUP BY 1), v AS (SELECT mask, (SELECT s FROM kept WHERE mask = 0) - s AS v FROM kept),
g AS (SELECT pl.t, a.mask, (b.v - a.v) * factorial(CAST(bit_count(a.mask) AS INTEGER)) * factorial(CAST(4 - bit_count(a.mask) AS INTEGER)) AS w, b.v - a.v AS d FROM pl CROSS JOIN v a JOIN v b ON b.mask = a.mask | (1 << CAST(pl.i AS INTEGER)) WHERE (a.mask >> CAST(pl.i AS INTEGER)) & 1 = 0)
SELECT t AS module, CAST((2 * sum(w) + 120) // 240 AS BIGINT) AS blame, CAST(max(CASE WHEN mask = 0 THEN d END) AS BIGINT) AS alone, true AS exact FROM g GROUP BY 1"""))
def shapley_exact(spark, sf):
    return _five(spark, sf).shapley()


@query()
def shapley_sampled(spark, sf):
    return graph(spark, sf).shapley()


@query(_sql(_BASE + ", wr AS (SELECT 'app/main' AS node UNION SELECT dst FROM wr JOIN ce ON node = src AND (ct IS NULL OR ct NOT IN ('nation/NATION_7', 'nation/NATION_9'))), s AS (SELECT CAST((SELECT sum(size) FROM live) AS BIGINT) AS a, CAST((SELECT sum(size) FROM pkg JOIN wr ON pkg = node) AS BIGINT) AS b) SELECT a AS original_size, a - b AS freed_bytes, b AS projected_size FROM s"))
def whatif(spark, sf):
    return graph(spark, sf).what_if(["nation/NATION_7", "nation/NATION_9"])


def _versions(packages: DataFrame) -> DataFrame:
    """A made-up directive for every module, by the length and the end of its name."""
    m = packages.filter("module <> ''").select("module").distinct()
    minor = 18 + F.length("module") % 7
    return m.select(F.lit("all").alias("graph_id"), "module", F.when(F.substring("module", -1, 1).isin("1", "3", "5"), F.concat(F.lit("1."), minor, F.lit(".0"))).otherwise(F.concat(F.lit("1."), minor)).alias("version"), ((F.col("module") == "app") | F.col("module").like("region/%")).alias("owned"))


_VER = "vm AS (SELECT DISTINCT module, (module = 'app' OR module LIKE 'region/%') AS owned, 18 + length(module) % 7 AS mi, substr(module, -1, 1) IN ('1', '3', '5') AS rel FROM {src} WHERE module <> ''), vk AS (SELECT *, '1.' || mi || CASE WHEN rel THEN '.0' ELSE '' END AS version, mi * 10 + CASE WHEN rel OR mi < 21 THEN 3 ELSE 0 END AS k FROM vm), tp AS (SELECT max(k) AS k FROM vk WHERE NOT owned)"
_FLOOR = " SELECT 'all' AS graph_id, coalesce((SELECT max_by(version, k) FROM vk WHERE NOT owned AND k = (SELECT k FROM tp) AND version = (SELECT max(version) FROM vk WHERE NOT owned AND k = (SELECT k FROM tp))), '') AS version, coalesce((SELECT string_agg(module, ',' ORDER BY module) FROM vk WHERE NOT owned AND k = (SELECT k FROM tp)), '') AS critical, coalesce((SELECT max_by(version, k) FROM vk WHERE NOT owned AND k < (SELECT k FROM tp)), '') AS next_version, coalesce((SELECT max_by(version, k) FROM vk WHERE owned), '') AS owned_max"


@query(_sql(_BASE + ", " + _VER.replace("{src}", "live") + _FLOOR))
def go_floor(spark, sf):
    return reports.floor(_versions(graph(spark, sf).base))


@query(_sql("wr AS (SELECT 'app/main' AS node UNION SELECT dst FROM wr JOIN ce ON node = src AND ct IS NULL), kept AS (SELECT pkg.* FROM pkg JOIN wr ON pkg = node), " + _VER.replace("{src}", "kept") + _FLOOR))
def floor_after_cut(spark, sf):
    g = graph(spark, sf)
    return reports.floor(_versions(g.reached(g.targets.select(F.lit("all").alias("cut_id"), "target"))))


def _cells(spark, sf):
    line = derived.read(spark, sf, "lineitem").select(F.expr(LABEL).alias("label"), F.concat(F.lit("part/"), "l_partkey").alias("pkg"))
    return line.join(derived.packages(spark, sf), "pkg").filter("module <> ''").select("label", "module", "pkg", "size").distinct()


_CELL = "cell AS (SELECT DISTINCT l_returnflag || '/' || l_linestatus AS label, module, pkg, size FROM lineitem JOIN pkg ON pkg = 'part/' || l_partkey WHERE module <> '')"


@query(_sql(_CELL + " SELECT label, count(DISTINCT module) AS modules, CAST(sum(size) AS BIGINT) AS bytes FROM cell GROUP BY 1"))
def matrix_cells(spark, sf):
    return _cells(spark, sf).groupBy("label").agg(F.count_distinct("module").alias("modules"), F.sum("size").alias("bytes"))


@query(_sql(_CELL + ", m AS (SELECT DISTINCT label, module FROM cell) SELECT module, string_agg(label, ',' ORDER BY label) AS in_cells, count(*) = (SELECT count(DISTINCT label) FROM cell) AS universal FROM m GROUP BY 1"))
def matrix_modules(spark, sf):
    cells = _cells(spark, sf)
    return reports.presence(cells, cells.select("label").distinct().count())


def _side(spark, sf, flag):
    return derived.sides(spark, sf).filter(F.col("label") == flag).groupBy("module").agg(F.sum("size").alias("size"))


_DIFF = _sql("""e0 AS (SELECT src, dst FROM edge WHERE src NOT LIKE 'supplier/%'),
el AS (SELECT l_returnflag AS f, 'supplier/' || l_suppkey AS src, 'part/' || l_partkey AS dst FROM lineitem WHERE l_returnflag IN ('R', 'A')),
ea AS (SELECT DISTINCT * FROM (SELECT f, src, dst FROM el UNION ALL SELECT f, src, dst FROM e0 CROSS JOIN (SELECT unnest(['R', 'A']) AS f))),
rr AS (SELECT unnest(['R', 'A']) AS f, 'app/main' AS node UNION SELECT rr.f, dst FROM rr JOIN ea ON node = src AND rr.f = ea.f),
pn AS (SELECT l_returnflag AS f, 'part/' || l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2),
sz AS (SELECT rr.f AS f, module, CAST(sum(size + coalesce(n, 0)) AS BIGINT) AS s FROM rr JOIN pkg ON node = pkg LEFT JOIN pn ON pn.f = rr.f AND p = node GROUP BY 1, 2),
dm AS (SELECT coalesce(b.module, h.module) AS module, b.s AS b, h.s AS h FROM (SELECT * FROM sz WHERE f = 'R') b FULL JOIN (SELECT * FROM sz WHERE f = 'A') h ON b.module = h.module),
di AS (SELECT module, CASE WHEN b IS NULL THEN 'added' WHEN h IS NULL THEN 'removed' ELSE 'changed' END AS status, coalesce(b, 0) AS base_size, coalesce(h, 0) AS head_size, coalesce(h, 0) - coalesce(b, 0) AS delta FROM dm WHERE module <> 'app' AND b IS DISTINCT FROM h)""")


@query(_DIFF + " SELECT * FROM di")
def diff_modules(spark, sf):
    return reports.diff(_side(spark, sf, "R"), _side(spark, sf, "A"), "app")


@query(_DIFF + " SELECT status, count(*) AS modules, CAST(sum(delta) AS BIGINT) AS delta FROM di GROUP BY 1")
def diff_summary(spark, sf):
    return diff_modules(spark, sf).groupBy("status").agg(F.count("*").alias("modules"), F.sum("delta").alias("delta"))


_SYM = """WITH sec0 AS (SELECT * FROM (VALUES (0, '.text', true, true, false), (1, '.rodata', true, false, false), (2, '.gopclntab', true, false, true), (3, '.debug_info', true, false, false), (4, '.bss', false, false, false), (5, '.data', true, false, false), (6, '.noptrdata', true, false, false)) s(sect, sname, backed, is_text, tab)),
sym AS (SELECT l_linenumber - 1 AS sect, l_orderkey * 64 + l_suppkey % 64 AS addr, 'mod%2eorg/' || lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || '.S' || l_partkey AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
sec AS (SELECT sec0.*, e FROM sec0 JOIN (SELECT sect, max(addr) + 64 AS e FROM sym GROUP BY 1) x ON sec0.sect = x.sect),
sz0 AS (SELECT sym.sect, addr, name, is_text, coalesce(lead(addr) OVER (PARTITION BY sym.sect ORDER BY addr, name), e) - addr AS bytes FROM sym JOIN sec ON sym.sect = sec.sect WHERE backed AND NOT tab AND sname NOT LIKE '%debug%'),
sz AS (SELECT * FROM sz0 WHERE bytes >= 0)"""


def _sized(spark, sf):
    s = derived.symbols(spark, sf)
    return sizes.symbol_sizes(s, derived.sections(spark, s))


@query(_SYM + " SELECT sect, count(*) AS symbols, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(bytes) AS BIGINT) AS largest FROM sz GROUP BY 1")
def symbol_sizes(spark, sf):
    return _sized(spark, sf).groupBy("sect").agg(F.count("*").alias("symbols"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))


@query(_SYM + ", p AS (SELECT replace(split_part(name, '.', 1), '%2e', '.') AS pkg, CAST(sum(bytes) AS BIGINT) AS b, CAST(sum(CASE WHEN is_text THEN bytes ELSE 0 END) AS BIGINT) AS code_bytes FROM sz GROUP BY 1), t AS (SELECT sum(code_bytes) AS t FROM p) SELECT pkg, CAST(b + CAST(1000000 AS HUGEINT) * code_bytes // (SELECT t FROM t) AS BIGINT) AS bytes, code_bytes FROM p")
def package_sizes(spark, sf):
    return sizes.package_sizes(_sized(spark, sf), 1_000_000)


@query(_sql("SELECT module, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS packages FROM pkg GROUP BY 1"))
def module_sizes(spark, sf):
    return sizes.module_sizes(derived.packages(spark, sf))


@query(_sql(_BASE + " SELECT CASE WHEN module = '' THEN 'std' WHEN module = 'app' THEN 'main' WHEN module LIKE 'region/%' THEN 'owned' ELSE 'third-party' END AS owner, CAST(sum(size) AS BIGINT) AS bytes FROM live GROUP BY 1"))
def size_breakdown(spark, sf):
    m = F.col("module")
    owner = F.when(m == "", "std").when(m == "app", "main").when(m.like("region/%"), "owned").otherwise("third-party")
    return graph(spark, sf).base.groupBy(owner.alias("owner")).agg(F.sum("size").alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f kB', n / 1000.0) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1000000.0) ELSE printf('%.1f GB', n / 1000000000.0) END AS text FROM (SELECT o_orderkey, CAST(round(o_totalprice * 1000) AS BIGINT) AS n FROM orders)")
def humanize_bytes(spark, sf):
    n = F.round(F.col("o_totalprice") * 1000).cast("long")
    return derived.read(spark, sf, "orders").select("o_orderkey", fn.humanize_bytes(n).alias("text"))


@query("SELECT r_name AS goos, n_name AS goarch FROM region CROSS JOIN nation WHERE NOT (r_name = 'AFRICA' OR n_nationkey % 5 = 0 AND r_regionkey = n_regionkey)")
def build_cells(spark, sf):
    """All platforms but the ignored ones; an empty field of a rule stands for any."""
    region, nation = derived.read(spark, sf, "region"), derived.read(spark, sf, "nation")
    rules = nation.filter("n_nationkey % 5 = 0").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("ro"), F.col("n_name").alias("ra")).unionByName(spark.createDataFrame([("AFRICA", "")], "ro string, ra string"))
    cells = region.select(F.col("r_name").alias("goos")).crossJoin(F.broadcast(nation.select(F.col("n_name").alias("goarch"))))
    return cells.join(F.broadcast(rules), (F.col("ro").isin("") | (F.col("ro") == F.col("goos"))) & (F.col("ra").isin("") | (F.col("ra") == F.col("goarch"))), "left_anti")
