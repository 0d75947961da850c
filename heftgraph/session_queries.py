"""Registered queries over one build under several policies, several builds at once, and sweeps by joins alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from heftgraph.operators import entry
from heftgraph.operators.policy import Policy
from heftgraph.operators.session import Session
from heftgraph.plans import derived
from heftgraph.plans.derived import graph
from heftgraph.queries import ORACLE_SQL, _BASE, _CLOSE, _EXCL, _FREED, _PRIZE, _sql, query


@query(_sql(_EXCL + ", " + _FREED + " SELECT * FROM fr"))
def exclusive_freed_joins(spark, sf):
    return graph(spark, sf, small=False).exclusive_freed()


@query(_sql(_BASE + ", " + _PRIZE + " SELECT * FROM pz"))
def prize_joins(spark, sf):
    return graph(spark, sf, small=False).prize()


@query(_sql(_BASE + ", " + _CLOSE + ", cp AS (SELECT t, pkg.* FROM clo JOIN pkg ON node = pkg) SELECT t AS target, count(*) AS packages, CAST(sum(size) AS BIGINT) AS bytes FROM cp GROUP BY 1"))
def closure_counts_joins(spark, sf):
    return graph(spark, sf, small=False).closure_counts()


def _dominator_sql() -> str:
    from heftgraph import detail_queries  # noqa: F401  (registers it)

    return ORACLE_SQL["dominator_tree"]


@query(_dominator_sql())
def dominator_tree_joins(spark, sf):
    return entry.dominator_tree(graph(spark, sf, small=False))


#: Three orders of the nations: by name, by name from the end, and by a multiple of the key.
_ORDERS = "ord AS (SELECT 0 AS o, t, row_number() OVER (ORDER BY t) AS p FROM tgt UNION ALL SELECT 1, t, row_number() OVER (ORDER BY t DESC) FROM tgt UNION ALL SELECT 2, 'nation/' || n_name, row_number() OVER (ORDER BY n_nationkey * 7 % 25, n_nationkey) FROM nation)"


@query(_sql(_BASE + ", " + _ORDERS + """, kr AS (SELECT o, p AS k, 'app/main' AS node FROM ord UNION SELECT kr.o, kr.k, ce.dst FROM kr JOIN ce ON kr.node = ce.src LEFT JOIN ord ON ord.o = kr.o AND ord.t = ce.ct WHERE ord.p IS NULL OR ord.p > kr.k),
kv AS (SELECT o, k, (SELECT sum(size) FROM live) - sum(size) AS v FROM kr JOIN pkg ON node = pkg GROUP BY 1, 2), kg AS (SELECT o, k, v - coalesce(lag(v) OVER (PARTITION BY o ORDER BY k), 0) AS d FROM kv)
SELECT t AS module, CAST(sum(d) AS BIGINT) AS gain FROM kg JOIN ord ON ord.o = kg.o AND ord.p = kg.k GROUP BY 1"""))
def shapley_orders(spark, sf):
    """What each nation adds to what the ones before it free, summed over three orders of all."""
    g = graph(spark, sf)
    names = derived.read(spark, sf, "nation").select(F.concat(F.lit("nation/"), "n_name").alias("t"), "n_nationkey")
    listed = lambda n, *by: names.agg(F.transform(F.sort_array(F.collect_list(F.struct(*by, "t"))), lambda x: x["t"]).alias("targets")).select(F.lit(n).alias("sample"), "targets")  # noqa: E731  25 nations
    up = listed(0)
    orders = up.union(up.select(F.lit(1), F.reverse("targets"))).union(listed(2, F.expr("n_nationkey * 7 % 25"), "n_nationkey"))
    return g.gains_along(orders)


@query(_sql(_EXCL + ", " + _FREED + """, c2 AS (SELECT 'app' AS m UNION SELECT module FROM pkg WHERE module LIKE 'region/%' UNION SELECT 'nation/' || n_name FROM nation WHERE n_regionkey = 1),
tgt2 AS (SELECT DISTINCT dm AS t FROM hop WHERE sm IN (SELECT m FROM c2) AND dm <> '' AND dm <> sm AND dm NOT IN (SELECT m FROM c2)),
ce2 AS (SELECT src, dst, CASE WHEN sm IN (SELECT m FROM c2) AND dm IN (SELECT t FROM tgt2) THEN dm END AS ct FROM hop),
cutr2 AS (SELECT t, 'app/main' AS node FROM tgt2 UNION SELECT t, dst FROM cutr2 JOIN ce2 ON node = src AND ct IS DISTINCT FROM t),
k2 AS (SELECT t, sum(size) AS b FROM cutr2 JOIN pkg ON node = pkg GROUP BY 1), lm AS (SELECT DISTINCT module FROM live WHERE module <> '')
SELECT 1 AS policy, lm.module AS module, CASE WHEN lm.module = 'app' THEN 'main' WHEN lm.module LIKE 'region/%' THEN '1st' WHEN fr.module IS NOT NULL THEN '2nd' ELSE '3rd' END AS class, coalesce(freed_bytes, 0) AS exclusive_bytes FROM lm LEFT JOIN fr ON lm.module = fr.module
UNION ALL SELECT 2, lm.module, CASE WHEN lm.module = 'app' THEN 'main' WHEN lm.module IN (SELECT m FROM c2) THEN '1st' WHEN t IS NOT NULL THEN '2nd' ELSE '3rd' END, CAST(coalesce((SELECT sum(size) FROM live) - b, 0) AS BIGINT) FROM lm LEFT JOIN k2 ON lm.module = t"""))
def session_reclassified(spark, sf):
    """One session under two policies: regions alone, and then regions with the nations of one of them."""
    s = Session(derived.build(spark, sf), derived.MAIN, derived.CONTROLLED)
    before = s.modules()
    names = [r[0] for r in derived.read(spark, sf, "nation").filter("n_regionkey = 1").select("n_name").collect()]
    s.reclassify(Policy(controlled=("region/...", *(f"nation/{n}" for n in names))))
    shown = lambda k, d: d.select(F.lit(k).alias("policy"), "module", "class", "exclusive_bytes")
    return shown(1, before).unionByName(shown(2, s.modules()))


@query(_sql("""e0 AS (SELECT src, dst FROM edge WHERE src NOT LIKE 'supplier/%'), fl AS (SELECT unnest(['A', 'N', 'R']) AS f),
ea AS (SELECT DISTINCT l_returnflag AS f, 'supplier/' || l_suppkey AS src, 'part/' || l_partkey AS dst FROM lineitem UNION ALL SELECT f, src, dst FROM e0 CROSS JOIN fl),
rr AS (SELECT f, 'app/main' AS node FROM fl UNION SELECT rr.f, dst FROM rr JOIN ea ON node = src AND rr.f = ea.f),
pn AS (SELECT l_returnflag AS f, 'part/' || l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT rr.f AS label, module, count(*) AS packages, CAST(sum(size + coalesce(n, 0)) AS BIGINT) AS bytes FROM rr JOIN pkg ON node = pkg LEFT JOIN pn ON pn.f = rr.f AND p = node GROUP BY 1, 2"""))
def matrix_builds(spark, sf):
    """What is reachable in three builds, those of the lines of each return flag, found in one set of jobs."""
    return derived.sides(spark, sf, ("A", "N", "R")).groupBy("label", "module").agg(F.count("*").alias("packages"), F.sum("size").alias("bytes"))
