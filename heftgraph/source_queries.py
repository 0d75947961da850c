"""Registered queries over package listings, source files, release platforms and report labels, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heftgraph.functions import labels
from heftgraph.plans import derived
from heftgraph.queries import query
from heftgraph.sources import imports, modules, platforms


def _listing(spark, sf):
    value = F.expr("""concat('{\n\t"ImportPath": "supplier/', s_suppkey, '",\n\t"Name": "s",\n\t"Module": {\n\t\t"Path": "nation/', s_nationkey, '",\n\t\t"Main": ', s_nationkey = 0, ',\n\t\t"Indirect": ', s_nationkey % 2 = 1, ',\n\t\t"Version": "v1.', s_nationkey, '"\n\t},\n\t"Imports": ["fmt", "supplier/', s_suppkey div 2, '"]')""")
    return modules.parsed(derived.read(spark, sf, "supplier").select(value.alias("value")))


@query("SELECT 'nation/' || s_nationkey AS module, 'v1.' || s_nationkey AS version, s_nationkey % 2 = 0 AS direct FROM supplier WHERE s_nationkey <> 0 GROUP BY s_nationkey")
def listed_modules(spark, sf):
    return modules.listed(modules.packages(_listing(spark, sf)))


@query("SELECT 'supplier/' || s_suppkey AS src, 'supplier/' || (s_suppkey // 2) AS dst FROM supplier WHERE s_suppkey // 2 IN (SELECT s_suppkey FROM supplier)")
def listed_imports(spark, sf):
    return modules.imports(_listing(spark, sf))


@query("SELECT 'app/' || n_nationkey || '.go' AS path, 5 AS line, 'region/' || n_regionkey || '/v2' AS import, 'r' AS alias, CASE WHEN n_nationkey % 2 = 0 THEN 'Load' ELSE 'Load,Save' || n_nationkey END AS symbols FROM nation WHERE n_nationkey % 5 <> 4")
def import_sites(spark, sf):
    text = F.expr("""concat('package app\n\nimport (\n\t"fmt"\n\tr "region/', n_regionkey, '/v2" // r.Hidden\n)\n\nfunc F() { fmt.Println(r.Load(), x.r.Other', if(n_nationkey % 2 = 0, '', concat(', r.Save', n_nationkey, '{}')), ') }\n/* r.Gone */\n')""")
    path = F.expr("concat(if(n_nationkey % 5 = 4, 'vendor/', 'app/'), n_nationkey, '.go')")
    files = imports.sources(derived.read(spark, sf, "nation").select(path.alias("path"), text.alias("text")))
    return imports.import_sites(files).filter("import like 'region/%'").withColumn("symbols", F.array_join("symbols", ","))


@query("""SELECT 'app/' || p_partkey || '.go' AS path, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 4 END AS line, 'brand/' || p_size AS import, 'b' AS alias,
CASE WHEN p_partkey % 3 = 0 THEN 'Options,Text' || p_partkey ELSE 'Options' END AS symbols FROM part""")
def import_sites_constants(spark, sf):
    """One file a part, whose comments and constants hold imports and names that don't count."""
    head = "concat('package app\n\n', if(p_partkey % 2 = 0, '/* import b \"brand/', '// import b \"brand/'), p_size, if(p_partkey % 2 = 0, '\"\n\n*/\n', '\"\n'), 'import b \"brand/', p_size, '\"\n')"
    body = """concat('var s = `\nimport c "c/d"\n', p_name, ' b.Raw // `\n', 'const q, r = "/* \\\\\\\\" + "b.Quoted \\\\"", \\'"\\'\n', 'func F(o ...b.Options) { ', if(p_partkey % 3 = 0, concat('b.\n\t\tText', p_partkey), 'x.b.Other'), '() } // "\n')"""
    files = derived.read(spark, sf, "part").select(F.expr("concat('app/', p_partkey, '.go')").alias("path"), F.expr(f"concat({head}, {body})").alias("text"))
    return imports.import_sites(files).withColumn("symbols", F.array_join("symbols", ","))


@query("""SELECT n_nationkey AS build_id, os, arch FROM nation, (VALUES ('linux'), ('darwin'), ('windows')) o(os), (VALUES ('amd64'), ('arm64')) a(arch)
WHERE n_nationkey % 3 <> 0 AND NOT (n_nationkey % 3 = 1 AND os = 'windows') AND NOT (n_nationkey % 2 = 0 AND os = 'darwin' AND arch = 'amd64')
UNION ALL SELECT n_nationkey, 'linux', 'arm64' FROM nation WHERE n_nationkey % 3 = 0""")
def release_cells(spark, sf):
    rules = "concat(if(n_nationkey % 3 = 1, array(struct('windows' as os, '' as arch)), array()), if(n_nationkey % 2 = 0, array(struct('darwin' as os, 'amd64' as arch)), array()))"
    builds = derived.read(spark, sf, "nation").selectExpr("n_nationkey as build_id", "if(n_nationkey % 3 = 0, array('linux_arm64', 'bad'), array()) as targets", "cast(null as array<string>) as systems", "cast(null as array<string>) as archs", f"cast({rules} as array<struct<os: string, arch: string>>) as ignore")
    return platforms.cells(builds)


@query("SELECT r_regionkey, array_to_string(list_slice(list(n_name ORDER BY n_name), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def joined_modules(spark, sf):
    by_region = derived.read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("a"))
    return by_region.select("r_regionkey", labels.join_modules(F.col("a")).alias("names"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'locked' WHEN p_size % 2 = 0 THEN 'direct' ELSE 'indirect' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'direct' ELSE 'transitive' END AS reach, CASE WHEN p_partkey % 3 = 0 THEN 'main' WHEN p_partkey % 3 = 1 THEN substr(md5(p_name), 1, 12) ELSE 'v' || p_size END AS rev, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 1000 > 0 THEN '-' ELSE '+' END || (p_partkey % 1000) || ' B' AS delta FROM part")
def report_labels(spark, sf):
    commit = F.expr("case p_partkey % 3 when 0 then '' when 1 then md5(p_name) else concat('v', p_size) end")
    locked, direct = F.expr("p_size % 5 = 0"), F.expr("p_size % 2 = 0")
    delta = F.expr("cast(if(p_partkey % 2 = 0, -1, 1) * (p_partkey % 1000) as bigint)")
    part = derived.read(spark, sf, "part")
    return part.select("p_partkey", labels.kind_label(locked, direct).alias("kind"), labels.direct_label(direct).alias("reach"), labels.short_commit(commit, F.lit("main")).alias("rev"), labels.signed_bytes(delta).alias("delta"))
