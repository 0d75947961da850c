"""Registered queries over made-up executables, budgets, single modules, sources in full, platforms, diffs and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heftgraph.functions import labels
from heftgraph.functions.scalars import short_module, symbol_package
from heftgraph.operators import anatomy, budget, order, prefix, reports, sizes
from heftgraph.operators import inspect as inspection
from heftgraph.operators.storage import stands, stored
from heftgraph.plans import derived, executables
from heftgraph.plans.derived import graph
from heftgraph import detail_queries  # noqa: F401  (some queries here build on its)
from heftgraph.queries import ORACLE_SQL, QUERIES, _BASE, _CELL, _DIFF, _EXCL, _FREED, _POT, _PRIZE, _BLOCK, _cells, _sql, diff_modules, query
from heftgraph.sources import binaries, imports

ONE = "nation/NATION_7"
KINDS = ("elf", "mach-o", "pe")
TEXT, DATA, ZERO, TABLE = ({"elf": e, "mach-o": m, "pe": p} for e, m, p in ((".text", "__TEXT __text", ".text"), (".data", "__DATA __data", ".data"), (".bss", "__DATA __bss", ".bss"), (".gopclntab", "__TEXT __gopclntab", ".rdata")))
_NAME = "case o_custkey % 4 when 0 then 'app/cmd.F' when 1 then concat('mod%2eorg/m', o_custkey % 3, '/x.F') when 2 then 'fmt.F' else 'type:x.F' end"
#: Bytes of the line table of unstripped files.
TABLE_BYTES = 4096


#: Orders or suppliers that one task writes.
WRITTEN = 1 << 18


def _files(spark, sf):
    """The executables of these tables; queries share them."""
    return derived.held(spark, sf, "executables", WRITTEN, make=lambda: stored(_made(spark, sf)), good=stands, tables=("orders", "supplier"))


def _made(spark, sf):
    """Three executables of one format each, whose symbols are orders, and a stripped one, whose functions are suppliers."""
    orders, suppliers = derived.read(spark, sf, "orders"), derived.read(spark, sf, "supplier")
    symbols = orders.selectExpr("o_orderkey % 3 as kind", f"concat({_NAME}, o_orderkey) as name", "cast(o_custkey % 2 as int) as sect", "o_orderkey * 16 as addr")
    functions = suppliers.selectExpr("3 as kind", "concat('mod%2eorg/m', s_suppkey % 3, '/x.F', s_suppkey) as name", "0 as sect", "s_suppkey % 50 as addr")
    runs = (orders.count() + suppliers.count()) // WRITTEN + 1
    listed = symbols.unionByName(functions).withColumn("run", F.expr(f"cast(pmod(xxhash64(name), {runs}) as int)"))
    length = "octet_length(name) + 1"
    last = lambda k: f"coalesce(max(if(sect = {k}, addr, null)), 0)"
    totals = listed.groupBy("kind", "run").agg(*map(F.expr, ("count(*) as n", f"sum({length}) as names", f"coalesce(sum(if({length} > {executables.SHORT + 1}, {length}, 0)), 0) as apart", f"{last(0)} as first", f"{last(1)} as second", "sum(addr) as bytes"))).collect()
    plans, before, rest = {}, {}, []
    for kind in sorted({r["kind"] for r in totals}):
        n = names = size = 0
        first, second, name = 0, 0, KINDS[kind % 3]
        for r in totals:  # each run has its place in the file
            if r["kind"] == kind:
                before[kind, r["run"]] = n, names, size
                n, names, size = n + r["n"], names + r["apart" if name == "pe" and kind != 3 else "names"], size + r["bytes"]
                first, second = max(first, r["first"]), max(second, r["second"])
        if kind == 3:
            lines = executables.Lines(n, names, 0x1000)
            plan = executables.elf_plan([(".text", 8192, True, b""), (".gopclntab", lines.size, True, b"")], 0, 0)
            plans[kind] = lines, plan.bodies[2]
            rest += [(f"bin{kind}", plan.bodies[2] + at, raw) for at, raw in lines.ends(size)]
        else:
            table = executables.line_table([], 0x1000)
            parts = [(TEXT[name], first + 64, True, b""), (DATA[name], second + 64, True, b""), (ZERO[name], 128, False, b""), (TABLE[name], TABLE_BYTES, True, table)]
            make, skip = {"elf": (executables.elf_plan, 1), "mach-o": (executables.mach_plan, 0), "pe": (executables.pe_plan, 0)}[name]
            plan = make(parts, n, names)
            plans[kind] = plan, skip
        rest += [(f"bin{kind}", at, raw) for at, raw in plan.pieces]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        done = dict(before)
        for batch in batches:
            kinds, parts, sects, addrs = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 4, 2, 3))
            texts = batch.column(1)
            for kind, part in sorted(set(zip(kinds.tolist(), parts.tolist(), strict=True))):
                which = np.flatnonzero((kinds == kind) & (parts == part))
                names = [n.encode() for n in texts.take(pa.array(which)).to_pylist()]
                n, length, size = done[kind, part]
                if kind == 3:
                    lines, start = plans[kind]
                    pieces = [(start + at, raw) for at, raw in lines.run(names, addrs[which], n, length, size)]
                else:
                    plan, skip = plans[kind]
                    pieces = plan.run(names, sects[which] + skip, addrs[which], n, length)
                least = executables.SHORT if kind != 3 and KINDS[kind] == "pe" else -1
                done[kind, part] = n + len(names), length + sum(len(x) + 1 for x in names if len(x) > least), size + int(addrs[which].sum())
                yield pa.RecordBatch.from_arrays([pa.array([f"bin{kind}"] * len(pieces), pa.string()), pa.array([at for at, _ in pieces], pa.int64()), pa.array([raw for _, raw in pieces], pa.binary())], names=["path", "at", "body"])

    fields = "path string, at long, body binary"
    written = listed.select("kind", "name", "sect", "addr", "run").repartition(runs, "run").mapInArrow(run, fields)
    return binaries.gathered(written.unionByName(spark.createDataFrame(rest, fields)))


_NAMES = "CASE o_custkey % 4 WHEN 0 THEN 'app/cmd.F' WHEN 1 THEN 'mod%2eorg/m' || (o_custkey % 3) || '/x.F' WHEN 2 THEN 'fmt.F' ELSE 'type:x.F' END || o_orderkey"
_PKGS = "CASE o_custkey % 4 WHEN 0 THEN 'app/cmd' WHEN 1 THEN 'mod.org/m' || (o_custkey % 3) || '/x' WHEN 2 THEN 'fmt' ELSE '<generated>' END"
_BIN = f"""WITH sy AS (SELECT o_orderkey % 3 AS kind, {_NAMES} AS name, {_PKGS} AS pkg, o_custkey % 2 AS sect, o_orderkey * 16 AS addr FROM orders),
few AS (SELECT kind FROM sy GROUP BY 1 HAVING count(*) >= 500),
se AS (SELECT kind, sect, max(addr) + 64 AS size FROM sy GROUP BY 1, 2),
sz AS (SELECT sy.*, coalesce(lead(addr) OVER (PARTITION BY sy.kind, sy.sect ORDER BY addr, name), size) - addr AS bytes FROM sy JOIN se ON sy.kind = se.kind AND sy.sect = se.sect WHERE sy.kind IN (SELECT kind FROM few)),
pk0 AS (SELECT kind, pkg, sum(bytes) AS b, sum(CASE WHEN sect = 0 THEN bytes ELSE 0 END) AS c, sum(CASE WHEN sect = 1 THEN bytes ELSE 0 END) AS d FROM sz GROUP BY 1, 2),
fn AS (SELECT 'mod.org/m' || (s_suppkey % 3) || '/x' AS pkg, sum(s_suppkey % 50) AS b FROM supplier WHERE s_suppkey % 50 > 0 GROUP BY 1),
pk AS (SELECT 'bin' || kind AS path, pkg, CAST(b + CASE WHEN kind = 2 THEN 0 ELSE {TABLE_BYTES} * c // sum(c) OVER (PARTITION BY kind) END AS BIGINT) AS bytes, CAST(c AS BIGINT) AS code_bytes, CAST(d AS BIGINT) AS data_bytes FROM pk0 UNION ALL SELECT 'bin3', pkg, b, b, 0 FROM fn)"""


@query(_BIN + f""" SELECT 'bin' || kind AS path, n.name AS name, n.backed AS file_backed, CAST(n.size AS BIGINT) AS size FROM (SELECT DISTINCT kind FROM sy) k CROSS JOIN LATERAL (
SELECT CASE kind WHEN 1 THEN '__TEXT __text' ELSE '.text' END AS name, true AS backed, coalesce((SELECT size FROM se WHERE se.kind = k.kind AND sect = 0), 64) AS size
UNION ALL SELECT CASE kind WHEN 1 THEN '__DATA __data' ELSE '.data' END, true, coalesce((SELECT size FROM se WHERE se.kind = k.kind AND sect = 1), 64)
UNION ALL SELECT CASE kind WHEN 1 THEN '__DATA __bss' ELSE '.bss' END, false, 128
UNION ALL SELECT CASE kind WHEN 0 THEN '.gopclntab' WHEN 1 THEN '__TEXT __gopclntab' ELSE '.rdata' END, true, {TABLE_BYTES}) n""")
def binary_sections(spark, sf):
    found = binaries.sections(_files(spark, sf)).filter("path <> 'bin3' and name not in ('', '.symtab', '.strtab', '.shstrtab')")
    return found.select("path", "name", "file_backed", "size")


@query(_BIN + " SELECT 'bin' || kind AS path, CASE WHEN kind = 1 THEN CASE sect WHEN 0 THEN '__TEXT __text' ELSE '__DATA __data' END ELSE CASE sect WHEN 0 THEN '.text' ELSE '.data' END END AS section, name, CAST(addr AS BIGINT) AS addr, CAST(bytes AS BIGINT) AS bytes FROM sz")
def binary_symbols(spark, sf):
    files = _files(spark, sf)
    held = binaries.sections(files)
    sized = sizes.symbol_sizes(binaries.symbols(files), held, anatomy.BY)
    return sized.join(held.select("path", "sect", F.col("name").alias("section")), ["path", "sect"]).select("path", "section", "name", "addr", "bytes")


@query(_BIN + " SELECT pkg, CAST(b AS BIGINT) AS bytes FROM fn")
def stripped_sizes(spark, sf):
    return anatomy.packages(_files(spark, sf)).filter("path = 'bin3'").select("pkg", "bytes")


@query(_BIN + " SELECT * FROM pk")
def binary_packages(spark, sf):
    return anatomy.packages(_files(spark, sf))


def _owned(spark, files):
    listed = spark.createDataFrame([("app/cmd", "app"), ("fmt", "")], "pkg string, module string")
    modules = spark.createDataFrame([("app",), ("mod.org/m0",), ("mod.org/m1",), ("mod.org",)], "module string")
    return anatomy.owned(stored(anatomy.packages(files)), listed, modules, "app")  # read three times


_MOD = ", ow AS (SELECT *, CASE WHEN pkg LIKE 'app/%' THEN 'app' WHEN pkg IN ('mod.org/m0/x', 'mod.org/m1/x') THEN left(pkg, 10) WHEN pkg LIKE 'mod.org/%' THEN 'mod.org' ELSE '' END AS module FROM pk), ms AS (SELECT path, module, CAST(sum(bytes) AS BIGINT) AS size FROM ow WHERE module <> '' GROUP BY 1, 2)"


@query(_BIN + _MOD + " SELECT *, row_number() OVER (PARTITION BY path ORDER BY size DESC, module) AS place FROM ms WHERE path = 'bin0' UNION ALL SELECT *, row_number() OVER (PARTITION BY path ORDER BY size DESC, module) FROM ms WHERE path = 'bin3'")
def size_modules(spark, sf):
    found = anatomy.module_sizes(_owned(spark, _files(spark, sf)))
    one = lambda path: order.ranked(found.filter(F.col("path") == path), order.named("size"))
    return one("bin0").unionByName(one("bin3")).select("path", "module", "size", "place")


@query(_BIN + _MOD + f""", ac AS (SELECT 'bin' || kind AS path, CAST({TABLE_BYTES} + (SELECT sum(size) FROM se WHERE se.kind = k.kind) + CASE kind WHEN 0 THEN 24 * (count(*) + 1) + 1 + sum(length(name) + 1) + 56 ELSE 0 END AS BIGINT) AS accounted_size, CAST(CASE kind WHEN 2 THEN 0 ELSE {TABLE_BYTES} END AS BIGINT) AS pclntab_size FROM sy k GROUP BY kind),
sm AS (SELECT path, CAST(sum(code_bytes) AS BIGINT) AS code_size, CAST(sum(data_bytes) AS BIGINT) AS data_size, CAST(sum(CASE WHEN pkg = 'fmt' THEN bytes ELSE 0 END) AS BIGINT) AS std_size, CAST(sum(CASE WHEN module = 'app' THEN bytes ELSE 0 END) AS BIGINT) AS main_size, CAST(sum(CASE WHEN pkg = '<generated>' THEN bytes ELSE 0 END) AS BIGINT) AS generated_size FROM ow GROUP BY 1)
SELECT ac.path AS path, accounted_size, pclntab_size, code_size, data_size, std_size, main_size, generated_size, false AS stripped FROM ac JOIN sm ON ac.path = sm.path WHERE (SELECT count(*) FROM few) = 3""")
def size_summary(spark, sf):
    files = _files(spark, sf).filter("not stripped")
    return anatomy.summary(files, _owned(spark, files)).drop("binary_size")


@query(_BIN + _MOD + " SELECT path, CAST(sum(CASE WHEN module NOT IN ('', 'app') THEN bytes ELSE 0 END) AS BIGINT) AS bytes FROM ow GROUP BY 1")
def size_third_party(spark, sf):
    files = _files(spark, sf)
    named = _owned(spark, files)
    parts = anatomy.breakdown(anatomy.summary(files, named), anatomy.module_sizes(named), "app")
    return parts.filter("part = 'third-party'").join(files.filter("part = 0").select("path"), "path").select("path", "bytes")


@query("WITH s AS (SELECT p_partkey, 'brand/' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/' || p_size ELSE '/' || p_size || '/deep' END AS path FROM part), m AS (SELECT DISTINCT 'brand/' || p_brand AS module FROM part UNION SELECT DISTINCT 'brand/' || p_brand || '/' || p_size FROM part WHERE p_size <= 10) SELECT p_partkey, (SELECT max_by(module, length(module)) FROM m WHERE s.path = module OR starts_with(s.path, module || '/')) AS module FROM s")
def symbol_module(spark, sf):
    part = derived.read(spark, sf, "part")
    paths = part.selectExpr("p_partkey", "concat('brand/', p_brand, case p_partkey % 3 when 0 then '' when 1 then concat('/', p_size) else concat('/', p_size, '/deep') end) as path")
    modules = part.selectExpr("concat('brand/', p_brand) as module").union(part.filter("p_size <= 10").selectExpr("concat('brand/', p_brand, '/', p_size)"))
    return paths.join(prefix.longest(paths, "path", modules), "path").select("p_partkey", "module")


def _sources(spark, sf):
    """A file a customer: imports of one or two packages of a nation, one in ten of them blank, and their uses."""
    text = F.expr("""concat('package p\n\nimport (\n\t"fmt"\n\t', if(c_custkey % 10 = 0, '_ ', ''), '"nation/', c_nationkey, '/a"\n', if(c_custkey % 2 = 0, concat('\tq "nation/', c_nationkey, '/b" // q.No\n'), ''), ')\n\nvar x = a.F', c_custkey % 7, if(c_custkey % 2 = 0, concat(' + q.G', c_custkey % 5), ''), '\n')""")
    return derived.read(spark, sf, "customer").select(F.expr("concat('d', c_custkey % 11, '/f', c_custkey, '.go')").alias("path"), text.alias("text"))


@query("""WITH c AS (SELECT *, 'nation/' || c_nationkey AS module FROM customer), u AS (SELECT module, 'a.F' || (c_custkey % 7) AS s FROM c WHERE c_custkey % 10 <> 0 UNION SELECT module, 'q.G' || (c_custkey % 5) FROM c WHERE c_custkey % 2 = 0),
n AS (SELECT module, count(*) AS distinct_symbols FROM u GROUP BY 1)
SELECT c.module AS module, CAST(sum(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS import_sites, count(DISTINCT c_custkey % 11) AS importing_packages, coalesce(any_value(distinct_symbols), 0) AS distinct_symbols FROM c LEFT JOIN n ON c.module = n.module GROUP BY 1""")
def source_coupling(spark, sf):
    pkgs = derived.read(spark, sf, "nation").selectExpr("explode(array(concat('nation/', n_nationkey, '/a'), concat('nation/', n_nationkey, '/b'))) as pkg", "concat('nation/', n_nationkey) as module", "'' as name")
    pkgs = pkgs.unionByName(spark.createDataFrame([("fmt", "", "fmt"), ("app/x", "app", "x")], "pkg string, module string, name string"))
    return imports.coupling(_sources(spark, sf), pkgs, "app")


@query("SELECT 'd' || (c_custkey % 11) || '/f' || c_custkey || '.go' AS path, 5 AS line, 'nation/7/a' AS import, CASE WHEN c_custkey % 11 = 3 THEN 'inner/mod' ELSE 'app/d' || (c_custkey % 11) END AS from_package FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'd' || (c_custkey % 11) || '/f' || c_custkey || '.go', 6, 'nation/7/b', CASE WHEN c_custkey % 11 = 3 THEN 'inner/mod' ELSE 'app/d' || (c_custkey % 11) END FROM customer WHERE c_nationkey = 7 AND c_custkey % 2 = 0")
def inspect_sites(spark, sf):
    modules = spark.createDataFrame([("app", "."), ("inner/mod", "d3")], "module string, dir string")
    return imports.sites_of(_sources(spark, sf), "nation/7", modules).select("path", "line", "import", "from_package")


_SPEC = budget.Budget("25 MB", "1.3", ("nation/NATION_2", "brand/Brand#1..."), {"brand/...": "3 MB", "nation/...": "5.5MB", "nation/NATION_1?": "6 MB"})
_HUMAN = "CASE WHEN {n} < 1000 THEN {n} || ' B' WHEN {n} < 1000000 THEN printf('%.1f kB', {n} / 1000.0) WHEN {n} < 1000000000 THEN printf('%.1f MB', {n} / 1000000.0) ELSE printf('%.1f GB', {n} / 1000000000.0) END"
_BROKEN = _BASE + ", ms AS (SELECT module, CAST(sum(size) AS BIGINT) AS size FROM live WHERE module <> '' GROUP BY 1), tt AS (SELECT CAST(sum(size) AS BIGINT) AS n FROM live), h AS (SELECT module, size, " + _HUMAN.replace("{n}", "size") + " AS t FROM ms), vi AS (SELECT 'max-binary-size' AS rule, '' AS module, '25 MB' AS limit_, " + _HUMAN.replace("{n}", "n") + " AS actual FROM tt WHERE n > 25000000 UNION ALL SELECT 'max-go-version', '', '1.3', '1.10' UNION ALL SELECT 'deny', module, CASE WHEN module = 'nation/NATION_2' THEN module ELSE 'brand/Brand#1...' END, 'present' FROM ms WHERE module = 'nation/NATION_2' OR module LIKE 'brand/Brand#1%' UNION ALL SELECT 'max-module-size', module, '3 MB', t FROM h WHERE module LIKE 'brand/%' AND size > 3000000 UNION ALL SELECT 'max-module-size', module, '5.5MB', t FROM h WHERE module LIKE 'nation/%' AND size > 5500000 UNION ALL SELECT 'max-module-size', module, '6 MB', t FROM h WHERE regexp_matches(module, '^nation/NATION_1[^/]$') AND size > 6000000)"


def _violations(spark, sf):
    base = graph(spark, sf).base
    modules = base.filter("module <> ''").groupBy("module").agg(F.sum("size").alias("size")).withColumn("in_build", F.lit(True))
    floor = spark.createDataFrame([("1.10",)], "version string")
    return budget.violations(base.agg(F.sum("size").alias("bytes")), floor, modules, _SPEC)


@query(_sql(_BROKEN + " SELECT rule, module, limit_ AS \"limit\", actual, 'fail' AS action FROM vi"))
def check_violations(spark, sf):
    return _violations(spark, sf).drop("message")


@query(_sql(_BROKEN + " SELECT count(*) = 0 AS passes, count(*) AS fails, CAST(0 AS BIGINT) AS warnings, true AS configured FROM vi"))
def check_summary(spark, sf):
    return budget.verdict(_violations(spark, sf), _SPEC)


def _versioned(g):
    m = g.nodes.filter("module <> ''").select("module").distinct()
    return m.select("module", F.concat(F.lit("1."), 18 + F.length("module") % 7, F.lit(".1")).alias("version"))


_FLOORS = "SELECT max(18 + length(module) % 7) AS n FROM pkg JOIN {r} ON pkg = node WHERE module <> '' AND module <> 'app' AND module NOT LIKE 'region/%'"
_SEV = f", wr AS (SELECT 'app/main' AS node UNION SELECT dst FROM wr JOIN ce ON node = src AND ct IS DISTINCT FROM '{ONE}')"


@query(_sql(_EXCL + ", " + _FREED + ", " + _BLOCK + ", " + _POT + _SEV + f", b AS ({_FLOORS.replace('{r}', 'base')}), a AS ({_FLOORS.replace('{r}', 'wr')}) SELECT '{ONE}' AS module, '2nd' AS class, false AS locked, false AS controlled, true AS target, (SELECT CAST(sum(size) AS BIGINT) FROM live WHERE module = '{ONE}') AS size, '1.' || (18 + length('{ONE}') % 7) || '.1' AS version, freed_bytes, potential_bytes, '1.' || b.n || '.1' AS floor_before, '1.' || a.n || '.1' AS floor_after, a.n < b.n AS moves_floor FROM fr JOIN pot ON fr.module = pot.module CROSS JOIN a CROSS JOIN b WHERE fr.module = '{ONE}'"))
def inspect(spark, sf):
    g = graph(spark, sf)
    return inspection.inspect(g, ONE, _versioned(g))


@query(_sql(_BASE + f", en AS (SELECT DISTINCT dst AS e, string_agg(DISTINCT src, ',' ORDER BY src) AS imported_by FROM ce JOIN base ON node = src WHERE ct = '{ONE}' GROUP BY 1), nr AS (SELECT DISTINCT e, 'app/main' AS node FROM en UNION SELECT e, dst FROM nr JOIN ce ON node = src AND dst <> e) SELECT e AS pkg, CAST(sum(size) AS BIGINT) AS retained, any_value(imported_by) AS imported_by FROM en CROSS JOIN live WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.e = en.e AND nr.node = live.pkg) GROUP BY 1"))
def inspect_entry(spark, sf):
    return inspection.entries(graph(spark, sf), ONE)


@query(_sql(_EXCL + ", " + _FREED + ", " + _PRIZE + " SELECT fr.module AS module, prize_bytes, freed_bytes, row_number() OVER (ORDER BY prize_bytes DESC, freed_bytes DESC, fr.module) AS place FROM fr JOIN pz ON fr.module = pz.module"))
def ranked_candidates(spark, sf):
    g = graph(spark, sf)
    return order.ranked(g.prize().join(g.exclusive_freed().select("module", "freed_bytes"), "module"), order.named("candidates"))


@query(_DIFF + " SELECT *, row_number() OVER (ORDER BY abs(delta) DESC, module) AS place FROM di")
def ranked_diff(spark, sf):
    return order.ranked(diff_modules(spark, sf), order.named("change"))


@query(_sql(_EXCL + " SELECT t AS target, unit AS module, bytes, row_number() OVER (PARTITION BY t ORDER BY bytes DESC, unit) AS place FROM (SELECT t, CASE WHEN module = '' THEN pkg ELSE module END AS unit, CAST(sum(size) AS BIGINT) AS bytes FROM ex GROUP BY 1, 2)"))
def ranked_freed(spark, sf):
    """Places within each target: a window a target, of the modules that leave with it."""
    from pyspark.sql import Window

    freed = graph(spark, sf).freed_breakdown().select(F.col("module").alias("target"), F.col("unit").alias("module"), "bytes")
    return freed.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(*order.named("bytes"))))


@query(_DIFF + " SELECT status, count(*) AS modules, CAST(sum(delta) AS BIGINT) AS net, count(*) FILTER (module NOT LIKE 'nation/%') AS transitive FROM di GROUP BY 1")
def diff_totals(spark, sf):
    direct = derived.read(spark, sf, "nation").select(F.concat(F.lit("nation/"), "n_name").alias("module"))
    return reports.diff_totals(diff_modules(spark, sf), direct)


_VERSION = "10 + length(module || label) % 3 + CAST(split_part(module, '#', 2) AS INTEGER) % 5"


@query(_sql(_CELL + f", vc AS (SELECT DISTINCT label, module, {_VERSION} AS n FROM cell), mx AS (SELECT label, max(n) AS n FROM vc GROUP BY 1), nx AS (SELECT vc.label, max(vc.n) AS n FROM vc JOIN mx ON vc.label = mx.label AND vc.n < mx.n GROUP BY 1), w AS (SELECT max(n) AS n FROM mx) SELECT '1.' || w.n AS version, (SELECT string_agg(DISTINCT module, ',' ORDER BY module) FROM vc WHERE n = w.n) AS critical, '1.' || (SELECT max(CASE WHEN mx.n = w.n THEN nx.n ELSE mx.n END) FROM mx LEFT JOIN nx ON mx.label = nx.label) AS next_version, '' AS owned_max FROM w"))
def matrix_worst(spark, sf):
    minor = F.expr("10 + length(concat(module, label)) % 3 + cast(substring_index(module, '#', -1) as int) % 5")
    modules = _cells(spark, sf).select("label", "module", F.concat(F.lit("1."), minor).alias("version"), F.lit(False).alias("owned")).distinct()
    return reports.worst(reports.floor(modules, "label"))


@query(_sql(_CELL + ", m AS (SELECT module, label, CAST(sum(size) AS BIGINT) AS s FROM cell GROUP BY 1, 2), v AS (SELECT module, '1.' || (10 + CAST(split_part(module, '#', 2) AS INTEGER) % 5) AS version, string_agg(label, ',' ORDER BY label) AS in_cells, count(*) = (SELECT count(DISTINCT label) FROM cell) AS universal, string_agg(label || '=' || s, ',' ORDER BY label) AS size_by_cell, max(s) AS max_size FROM m GROUP BY module) SELECT *, row_number() OVER (ORDER BY universal, CAST(split_part(version, '.', 2) AS INTEGER) DESC, module) AS place FROM v"))
def matrix_module_rows(spark, sf):
    cells = _cells(spark, sf)
    versions = cells.select("module").distinct().select("module", F.expr("concat('1.', 10 + cast(substring_index(module, '#', -1) as int) % 5)").alias("version"))
    out = order.ranked(reports.matrix_rows(cells, versions), order.named("matrix"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("size_by_cell")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("size_by_cell", listed)


@query(_sql(_EXCL + ", " + _FREED + ", " + _PRIZE + " SELECT count(*) AS targets, max_by(fr.module, (freed_bytes, fr.module)) AS easiest, max(freed_bytes) AS easiest_bytes, max_by(fr.module, (prize_bytes, fr.module)) AS biggest, max(prize_bytes) AS biggest_bytes FROM fr JOIN pz ON fr.module = pz.module"))
def prune_headline(spark, sf):
    g = graph(spark, sf)
    return reports.headline(g.exclusive_freed().join(g.prize(), "module"))


@query("SELECT p_partkey, printf('%.1f%%', 100.0 * p_size / 32) AS share, split_part(p_type, ' ', -1) AS last FROM part")
def share_labels(spark, sf):
    part = derived.read(spark, sf, "part")
    path = F.replace("p_type", F.lit(" "), F.lit("/"))
    return part.select("p_partkey", labels.percent_text(F.col("p_size"), F.lit(32)).alias("share"), short_module(path).alias("last"))


@query("SELECT n_nationkey, '-X main.v=0 -tags=' || n_name || '-0' AS flags FROM nation")
def template_blanks(spark, sf):
    text = F.expr("concat('-X main.v={{.Version}} -tags=', n_name, '-{{ if .Env.A }}x{{end}}')")
    return derived.read(spark, sf, "nation").select("n_nationkey", labels.without_templates(F.replace(text, F.lit("x{{end}}"), F.lit(""))).alias("flags"))


@query("SELECT n_nationkey, sha256('1' || chr(0) || md5(n_name) || chr(0) || n_name || chr(0) || 'a,b' || chr(0) || 'A=' || n_regionkey || ',B=x' || chr(0)) AS key FROM nation")
def snapshot_keys(spark, sf):
    """Keys don't depend on the order in which tags and variables are given."""
    nation = derived.read(spark, sf, "nation")
    tags = F.expr("if(n_nationkey % 2 = 0, array('b', 'a', ' b '), array('a', '', 'b'))")
    env = F.expr("if(n_nationkey % 3 = 0, map('B', 'x', 'A', cast(n_regionkey as string)), map('A', cast(n_regionkey as string), 'B', 'x'))")
    return nation.select("n_nationkey", labels.snapshot_key(F.lit("1"), F.md5(F.col("n_name").cast("binary")), F.col("n_name"), tags, env).alias("key"))


@query(_sql(_BASE + ", " + _EXCL.split("live AS (SELECT pkg.* FROM pkg JOIN base ON pkg = node), ", 1)[1] + f", g AS (SELECT module, CAST(sum(size) AS BIGINT) AS bytes FROM ex WHERE t = '{ONE}' GROUP BY 1), w AS (SELECT module, sum(size) AS total FROM live GROUP BY 1) SELECT g.module AS module, bytes, total > 0 AND bytes >= total AND g.module <> '' AS whole FROM g JOIN w ON g.module = w.module"))
def whatif_freed(spark, sf):
    return graph(spark, sf).freed_list([ONE])


def _placed(name: str, by: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {by}) AS place FROM ({ORACLE_SQL[name]})"


@query(_placed("shapley_exact", "blame DESC, module"))
def ranked_blame(spark, sf):
    return order.ranked(QUERIES["shapley_exact"](spark, sf), order.named("blame"))


@query(_placed("entry_weights", "retained DESC, pkg"))
def ranked_entries(spark, sf):
    return order.ranked(QUERIES["entry_weights"](spark, sf), order.named("entries"))


@query(_placed("inspect_sites", "path, line, \"import\""))
def ranked_sites(spark, sf):
    return order.ranked(QUERIES["inspect_sites"](spark, sf), order.named("sites"))


@query(_placed("session_modules", "prize_bytes DESC, bytes DESC, module"))
def ranked_session(spark, sf):
    found = QUERIES["session_modules"](spark, sf).withColumnRenamed("bytes", "size")
    return order.ranked(found, order.named("explorer")).withColumnRenamed("size", "bytes")


@query("SELECT s_suppkey, 'a%/b c+d.org/x' || s_suppkey || '%z' AS pkg FROM supplier")
def unescaped_packages(spark, sf):
    """Only whole escapes are decoded; a '+' stays."""
    name = F.expr("concat('a%/b%20c+d%2eorg/x', s_suppkey, '%z.F')")
    return derived.read(spark, sf, "supplier").select("s_suppkey", symbol_package(name).alias("pkg"))
