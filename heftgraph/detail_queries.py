"""More registered queries: single modules and selections, entries, floors over platforms and snapshots, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heftgraph.functions import scalars as fn
from heftgraph.operators import entry, reports, session, sizes
from heftgraph.plans import derived
from heftgraph.plans.derived import graph
from heftgraph.queries import _BASE, _CELL, _DIFF, _EXCL, _FLOOR, _FREED, _PRIZE, _SYM, _VER, _cells, _side, _sized, _sql, _versions, query
from heftgraph.sources import references

ONE = "nation/NATION_7"
CELLS = ("A/F", "A/O", "N/F", "N/O", "R/F", "R/O")
_IMP = "im AS (SELECT DISTINCT sm, dm FROM ce WHERE sm <> '' AND dm <> '' AND sm <> dm AND src IN (SELECT node FROM base) AND dst IN (SELECT node FROM base))"
_OWN = "ms AS (SELECT module, CAST(sum(size) AS BIGINT) AS bytes FROM live GROUP BY 1)"
_DRAG = _IMP + f""", cl AS (SELECT pkg AS node FROM pkg WHERE module = '{ONE}' UNION SELECT dst FROM cl JOIN ce ON node = src),
rc AS (SELECT 'app/main' AS node UNION SELECT dst FROM rc JOIN ce ON node = src AND ct IS DISTINCT FROM '{ONE}'), rm AS (SELECT DISTINCT module FROM pkg JOIN rc ON pkg = node),
dp AS (SELECT DISTINCT module FROM live JOIN cl ON pkg = node WHERE module NOT IN ('', '{ONE}')),
nb AS (SELECT dm, string_agg(sm, ',' ORDER BY sm) AS needed_by FROM im WHERE sm <> '{ONE}' AND sm IN (SELECT module FROM rm) AND dm IN (SELECT module FROM rm) GROUP BY 1),
dr AS (SELECT dp.module AS module, bytes, dp.module NOT IN (SELECT module FROM rm) AS freed, coalesce(needed_by, '') AS needed_by FROM dp JOIN ms ON dp.module = ms.module LEFT JOIN nb ON dp.module = dm)"""


@query(_sql("lv AS (SELECT 'supplier/' || l_suppkey AS p FROM lineitem WHERE l_quantity >= 30 UNION SELECT 'part/' || l_partkey FROM lineitem WHERE l_quantity >= 30 UNION SELECT 'region/' || n_regionkey FROM nation UNION SELECT 'nation/' || n_nationkey FROM nation UNION SELECT 'app/main') SELECT src, dst FROM edge WHERE src IN (SELECT p FROM lv) AND dst IN (SELECT p FROM lv)"))
def live_edges(spark, sf):
    line, nation, supplier, part = (derived.read(spark, sf, t) for t in ("lineitem", "nation", "supplier", "part"))
    dump = line.filter("l_quantity >= 30").selectExpr("concat('supplier/', l_suppkey, '.F -> part/', l_partkey, '.G') as value")
    dump = dump.union(nation.selectExpr("concat('region/', n_regionkey, '.init -> nation/', n_nationkey, '.(*T).Run') as value"))
    dump = dump.union(supplier.selectExpr("concat('supplier/', s_suppkey, '.F.stkobj -> ', 'type:int') as value")).union(part.selectExpr("concat('# part/', p_partkey, '.G -> main.main') as value"))
    g = graph(spark, sf)
    return references.narrowed(g.edges, references.live_packages(dump, g.packages.select("pkg"), "app/main"), g.roots)


@query()
def plan_freed_coprune(spark, sf):
    g = graph(spark, sf)
    return session.plan_freed(g, [r["module"] for r in g.plan().orderBy("step").collect()])


@query(_sql(_BASE + f", sr AS (SELECT 'app/main' AS node UNION SELECT dst FROM sr JOIN ce ON node = src AND ct IS DISTINCT FROM '{ONE}'), mr AS (SELECT t, 'app/main' AS node FROM tgt UNION SELECT t, dst FROM mr JOIN ce ON node = src AND ct IS DISTINCT FROM t AND ct IS DISTINCT FROM '{ONE}'), kb AS (SELECT sum(size) AS b FROM pkg JOIN sr ON pkg = node) SELECT t AS module, CAST((SELECT b FROM kb) - sum(size) AS BIGINT) AS marginal FROM mr JOIN pkg ON pkg = node GROUP BY 1"))
def marginal(spark, sf):
    return session.marginals(graph(spark, sf), [ONE])


@query(_sql(_BASE + ", " + _OWN + ", " + _DRAG + " SELECT * FROM dr"))
def dragout_status(spark, sf):
    return session.drag_out(graph(spark, sf), ONE)


_LISTED = _EXCL + ", " + _FREED + ", " + _PRIZE + ", " + _OWN


@query(_sql(_LISTED + ", " + _IMP + ", fi AS (SELECT dm, count(DISTINCT sm) AS n FROM ce WHERE dm <> '' AND sm <> dm AND src IN (SELECT node FROM base) AND dst IN (SELECT node FROM base) GROUP BY 1) SELECT ms.module AS module, bytes, CASE WHEN ms.module = 'app' THEN 'main' WHEN ms.module LIKE 'region/%' THEN '1st' WHEN freed_bytes IS NOT NULL THEN '2nd' ELSE '3rd' END AS class, coalesce(freed_bytes, 0) AS exclusive_bytes, coalesce(prize_bytes, 0) AS prize_bytes, coalesce(n, 0) AS importers FROM ms LEFT JOIN fr ON ms.module = fr.module LEFT JOIN pz ON ms.module = pz.module LEFT JOIN fi ON ms.module = dm WHERE ms.module <> ''"))
def session_modules(spark, sf):
    g = graph(spark, sf)
    own = sizes.module_sizes(g.base).filter("module <> ''").select("module", "bytes")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = own.join(g.classes.select("module", "class"), "module").join(g.exclusive_freed().select("module", F.col("freed_bytes").alias("exclusive_bytes")), "module", "left").join(g.prize(), "module", "left").join(g.fan_in(), "module", "left")
    return out.select("module", "bytes", "class", zero("exclusive_bytes"), zero("prize_bytes"), zero("importers"))


@query(_sql(_LISTED + ", " + _DRAG + f" SELECT fr.module AS module, ms.bytes AS bytes, freed_bytes AS exclusive_bytes, prize_bytes, CAST(freed_bytes + (SELECT coalesce(sum(bytes), 0) FROM dr WHERE NOT freed) AS BIGINT) AS pulls_in FROM fr JOIN pz ON fr.module = pz.module JOIN ms ON fr.module = ms.module WHERE fr.module = '{ONE}'"))
def session_detail(spark, sf):
    """Own, exclusive and prize bytes of a target, and with them what it holds of modules that stay."""
    g = graph(spark, sf)
    held = session.drag_out(g, ONE).filter("not freed").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("held"))
    own = sizes.module_sizes(g.base).select("module", "bytes")
    return own.filter(F.col("module") == ONE).join(g.exclusive_freed(), "module").join(g.prize(), "module").crossJoin(held).select("module", "bytes", F.col("freed_bytes").alias("exclusive_bytes"), "prize_bytes", (F.col("freed_bytes") + F.col("held")).alias("pulls_in"))


_FLOW = _BASE + ", fl AS (SELECT '' AS s, 'app/main' AS d UNION SELECT src, dst FROM ce JOIN base ON node = src WHERE ct IS NULL UNION SELECT src, 'gw:' || ct FROM ce JOIN base ON node = src WHERE ct IS NOT NULL UNION SELECT 'gw:' || ct, dst FROM ce JOIN base ON node = src WHERE ct IS NOT NULL), nd AS (SELECT DISTINCT d AS v FROM fl), rm AS (SELECT v AS x, '' AS node FROM nd UNION SELECT x, d FROM rm JOIN fl ON node = s AND d <> x), dm AS (SELECT a.v AS x, b.v AS v FROM nd a JOIN nd b ON a.v <> b.v WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.x = a.v AND rm.node = b.v)), ct2 AS (SELECT v, count(*) AS c FROM dm GROUP BY 1)"


@query(_sql(_FLOW + ", im AS (SELECT dm.v AS v, max_by(x, coalesce(c, 0)) AS idom FROM dm LEFT JOIN ct2 ON dm.x = ct2.v GROUP BY 1), sb AS (SELECT x, CAST(sum(size) AS BIGINT) AS b FROM dm JOIN pkg ON pkg = dm.v GROUP BY 1) SELECT nd.v AS node, CASE WHEN pkg IS NULL THEN 'gateway' ELSE 'package' END AS kind, coalesce(module, substr(nd.v, 4)) AS module, coalesce(idom, '') AS idom, CAST(coalesce(size, 0) + coalesce(b, 0) AS BIGINT) AS retained FROM nd LEFT JOIN pkg ON pkg = nd.v LEFT JOIN im ON im.v = nd.v LEFT JOIN sb ON sb.x = nd.v"))
def dominator_tree(spark, sf):
    return entry.dominator_tree(graph(spark, sf))


@query(_sql(_BASE + ", en AS (SELECT DISTINCT ct, dst AS e FROM ce JOIN base ON node = src WHERE ct IS NOT NULL), nr AS (SELECT DISTINCT e, 'app/main' AS node FROM en UNION SELECT e, dst FROM nr JOIN ce ON node = src AND dst <> e) SELECT ct AS module, e AS pkg, CAST(sum(size) AS BIGINT) AS retained FROM en CROSS JOIN live WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.e = en.e AND nr.node = live.pkg) GROUP BY 1, 2"))
def entry_weights(spark, sf):
    return entry.entry_weights(graph(spark, sf))


@query()
def import_why(spark, sf):
    return session.import_why(graph(spark, sf))


@query(_sql(_BASE + ", " + _VER.replace("{src}", "live") + ", fl AS (" + _FLOOR + "), lo AS (SELECT *, owned_max <> '' AND (version = '' OR (SELECT max(k) FROM vk WHERE owned) > (SELECT k FROM tp)) AS can FROM fl) SELECT can AS can_lower_now, CASE WHEN can THEN version ELSE '' END AS lower_to, critical AS blocked_by, next_version AS then_reaches FROM lo"))
def go_action(spark, sf):
    return reports.verdict(reports.floor(_versions(graph(spark, sf).base)))


_CELL_VER = _CELL + ", cv AS (SELECT label, max(10 + CAST(split_part(module, '#', 2) AS INTEGER) % 7 + length(label || module) % 2) AS n FROM cell GROUP BY 1)"


@query(_sql(_CELL_VER + " SELECT label, '1.' || n AS version, n = (SELECT max(n) FROM cv) AS pins FROM cv"))
def matrix_worst_floor(spark, sf):
    cells = _cells(spark, sf)
    minor = F.expr("10 + cast(substring_index(module, '#', -1) as int) % 7 + length(concat(label, module)) % 2")
    return reports.worst_floor(reports.floor(cells.select("label", "module", F.concat(F.lit("1."), minor).alias("version"), F.lit(False).alias("owned")), "label"), "label")


@query(_sql(_CELL + " SELECT module, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN label = '{c}' THEN size END), 0) AS BIGINT) AS {c.replace('/', '_').lower()}" for c in CELLS) + " FROM cell GROUP BY 1"))
def matrix_grid(spark, sf):
    grid = _cells(spark, sf).groupBy("module").pivot("label", list(CELLS)).agg(F.sum("size"))
    return grid.select("module", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c.replace("/", "_").lower()) for c in CELLS))


@query(_DIFF + ", vd AS (SELECT f, module, 10 + s % 37 AS n FROM sz WHERE module <> '' AND module <> 'app' AND module NOT LIKE 'region/%'), mx AS (SELECT f, max(n) AS n FROM vd GROUP BY 1), cr AS (SELECT vd.f, module FROM vd JOIN mx ON vd.f = mx.f AND vd.n = mx.n) SELECT '1.' || b.n AS before, '1.' || h.n AS after, CAST(sign(h.n - b.n) AS INTEGER) AS direction, coalesce((SELECT string_agg(module, ',' ORDER BY module) FROM cr WHERE f = 'A' AND module NOT IN (SELECT module FROM cr WHERE f = 'R')), '') AS newly_critical FROM mx b JOIN mx h ON b.f = 'R' AND h.f = 'A'")
def diff_floor(spark, sf):
    def one(flag):
        m = _side(spark, sf, flag).filter("module <> ''")
        return reports.floor(m.selectExpr("'all' as graph_id", "module", "concat('1.', 10 + size % 37) as version", "module = 'app' or startswith(module, 'region/') as owned"))

    return reports.diff_floor(one("R"), one("A"))


@query(_SYM + " SELECT CAST(row_number() OVER (ORDER BY e DESC, sname) AS INTEGER) AS place, sname AS section, CAST(e AS BIGINT) AS bytes FROM sec QUALIFY place <= 8")
def sections_top(spark, sf):
    found = derived.sections(spark, derived.symbols(spark, sf))
    place = F.row_number().over(Window.orderBy(F.desc("size"), "name"))  # a handful of sections
    return found.select(place.alias("place"), F.col("name").alias("section"), F.col("size").cast("long").alias("bytes")).filter("place <= 8")


@query(_SYM + ", p AS (SELECT replace(split_part(name, '.', 1), '%2e', '.') AS pkg, sum(CASE WHEN is_text THEN bytes ELSE 0 END) AS c FROM sz GROUP BY 1) SELECT pkg, CAST(CAST(1000000 AS HUGEINT) * c // (SELECT sum(c) FROM p) AS BIGINT) AS share FROM p")
def pclntab_share(spark, sf):
    with_table, without = (sizes.package_sizes(_sized(spark, sf), n) for n in (1_000_000, 0))
    return with_table.select("pkg", "bytes").join(without.select("pkg", F.col("bytes").alias("own")), "pkg").select("pkg", (F.col("bytes") - F.col("own")).alias("share"))


@query(_SYM + " SELECT DISTINCT name, replace(split_part(name, '.', 1), '%2e', '.') AS pkg FROM sym")
def symbol_package(spark, sf):
    names = derived.symbols(spark, sf).select("name").distinct()
    return names.select("name", fn.symbol_package(F.col("name")).alias("pkg"))


_SUFFIX = "CASE p_partkey % 6 WHEN 0 THEN '.argliveinfo' WHEN 1 THEN '.arginfo7' WHEN 2 THEN '.arginfo' WHEN 3 THEN '.stkobj' WHEN 4 THEN '.stkobj.f' ELSE '' END"


@query(f"SELECT p_partkey, p_partkey % 6 IN (0, 1, 3) AS aux FROM (SELECT p_partkey, p_brand || {_SUFFIX} AS name FROM part)")
def aux_filter(spark, sf):
    part = derived.read(spark, sf, "part")
    return part.select("p_partkey", fn.is_aux_symbol(F.concat("p_brand", F.expr(_SUFFIX))).alias("aux"))


@query("SELECT o_orderkey, CAST(trunc(CAST((o_orderkey % 900 + 1) || '.' || (o_custkey % 10) AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1000000000 END) AS BIGINT) AS bytes FROM orders")
def parse_bytes(spark, sf):
    text = F.expr("concat(o_orderkey % 900 + 1, '.', o_custkey % 10, case o_orderkey % 3 when 0 then ' kB' when 1 then 'mb' else ' GB ' end)")
    return derived.read(spark, sf, "orders").select("o_orderkey", fn.parse_bytes(text).alias("bytes"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'vx' ELSE lower(p_brand) END AS alias FROM part")
def pkg_alias(spark, sf):
    path = F.expr("concat('example.org/', lower(p_brand), case p_partkey % 4 when 0 then '/v2' when 3 then '/vx' else '' end)")
    return derived.read(spark, sf, "part").select("p_partkey", fn.package_alias(path).alias("alias"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'host' ELSE n_name END || '/' || 'arch' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '+netgo,osusergo' ELSE '' END AS label FROM nation")
def platform_label(spark, sf):
    tags = F.expr("if(n_nationkey % 2 = 0, array('osusergo', 'netgo', 'osusergo'), array())")
    os = F.expr("if(n_nationkey % 3 = 0, '', n_name)")
    return derived.read(spark, sf, "nation").select("n_nationkey", fn.platform_label(os, F.concat(F.lit("arch"), "n_regionkey"), tags).alias("label"))
