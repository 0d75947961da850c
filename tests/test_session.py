"""One build under several policies, several builds at once, answers in full, and cells that can't be read."""

import pytest
from test_graph import POLICY, Drawn, rows

from heftgraph import tools
from heftgraph.analysis import matrix
from heftgraph.operators import kernel
from heftgraph.operators.build import Build, together
from heftgraph.operators.policy import Policy
from heftgraph.operators.prune import Graph
from heftgraph.operators.session import Session, importers
from heftgraph.plans import derived

OTHER = Policy(controlled=("ours/...", "m0", "m1"), locked=("m3",))
COLUMNS = ("module", "bytes", "class", "locked", "target", "exclusive_bytes", "prize_bytes", "importers", "pinned_by")


@pytest.mark.parametrize("small", [True, False])
def test_two_policies_are_two_graphs(spark, small):
    d = Drawn(31)
    g = d.graph(spark, small)
    s = Session(g.build, "home", POLICY)
    nodes, links, base = s.build.nodes, s.build.links, s.build.base
    for policy in (POLICY, OTHER, POLICY):
        s.reclassify(policy)
        fresh = Graph(g.packages, g.edges, g.roots, "home", policy, small)
        assert rows(s.modules(), *COLUMNS) == rows(Session(fresh.build, "home", policy).modules(), *COLUMNS)
        assert rows(s.graph.exclusive_freed(), "module", "freed_bytes") == rows(fresh.exclusive_freed(), "module", "freed_bytes")
    # nodes, links and what is reachable were written once
    assert s.build.nodes is nodes and s.build.links is links and s.build.base is base and s.graph.build is g.build
    assert rows(s.graph.classes, "module", "class") != rows(s.graph.reclassified(OTHER).classes, "module", "class")


def test_questions_of_a_session(spark):
    d = Drawn(31)
    g = d.graph(spark)
    versions = spark.createDataFrame([("m0", "1.21"), ("m1", "1.19"), ("home", "1.20")], "module string, version string")
    sites = spark.createDataFrame([("m0", 4)], "module string, import_sites long")
    s = Session(g.build, "home", POLICY, versions, sites)
    t = d.targets[0]
    held = {r["module"]: r for r in s.modules().collect()}
    assert set(held) == {d.module[p] for p in d.reach()} - {""}
    assert all(r["bytes"] == sum(d.size[p] for p in d.reach() if d.module[p] == m) for m, r in held.items())
    assert all(r["version"] == {"m0": "1.21", "m1": "1.19", "home": "1.20"}.get(m, "") and r["import_sites"] == (4 if m == "m0" else 0) for m, r in held.items())
    freed = {r["module"]: r["bytes"] for r in s.freed([t]).collect()}
    assert sum(freed.values()) == d.bytes(d.freed({t}))
    got = s.detail(t)
    (summary,) = got["summary"].collect()
    stay = sum(r["bytes"] for r in got["drags"].collect() if not r["freed"])
    assert summary["module"] == t and summary["pulls_in"] == summary["exclusive_bytes"] + stay == d.bytes(d.freed({t})) + stay
    both = set(rows(importers(g), "module", "importer"))
    assert {r[0] for r in rows(got["importers"], "module")} == {i for m, i in both if m == t}
    assert {r[0] for r in rows(got["importees"], "module")} == {m for m, i in both if i == t}
    assert {r["root"] for r in got["why"].collect()} <= {t}
    before, after = s.floor().first(), s.floor(d.targets).first()
    assert before["owned_max"] == "1.20" and after["owned_max"] == "1.20"


def test_orders_walked_backwards(spark):
    """Gains along an order, by one growing sweep, by joins, and as differences of plain sets."""
    d = Drawn(29)
    ts = d.targets
    orders = [ts, ts[::-1], ts[1:] + ts[:1]]
    want = {}
    for order in orders:
        for k, t in enumerate(order):
            want[t] = want.get(t, 0) + d.bytes(d.freed(set(order[: k + 1]))) - d.bytes(d.freed(set(order[:k])))
    frame = spark.createDataFrame(list(enumerate(orders)), "sample int, targets array<string>")
    for small in (True, False):
        assert rows(d.graph(spark, small).gains_along(frame), "module", "gain") == sorted(want.items())


def test_closure_words(spark, monkeypatch):
    """Targets in several words of bits: the same closures, counts and shares."""
    d = Drawn(26)
    whole = d.graph(spark)
    for small in (True, False):
        g = d.graph(spark, small)
        monkeypatch.setattr("heftgraph.operators.prune.WORD", 2)
        got = [rows(g.closures, "target", "pkg"), rows(g.closure_counts(), "target", "packages", "bytes"), rows(g.potential(), "module", "potential_bytes", "shared_bytes"), rows(g.shared_with(), "module", "holder", "bytes", "also_via")]
        assert g.words.count() == -(-len(d.targets) // 2) > 1
        monkeypatch.setattr("heftgraph.operators.prune.WORD", kernel.WORD)
        assert got == [rows(whole.closures, "target", "pkg"), rows(whole.closure_counts(), "target", "packages", "bytes"), rows(whole.potential(), "module", "potential_bytes", "shared_bytes"), rows(whole.shared_with(), "module", "holder", "bytes", "also_via")]


def test_builds_together(spark):
    drawn = {"a/x": Drawn(3), "b": Drawn(4), "c": Drawn(5)}
    parts = {label: (g.packages, g.edges, g.roots) for label, g in ((label, d.graph(spark)) for label, d in drawn.items())}
    want = sorted((label, p, d.module[p], d.size[p]) for label, d in drawn.items() for p in d.reach())
    for small in (True, False):
        assert rows(together(parts, small), "label", "pkg", "module", "size") == want
    with pytest.raises(ValueError):
        together({})
    with pytest.raises(ValueError):
        together({"a\x01": parts["b"]})


def test_cells_that_fail(spark):
    """A platform that can't be read has a row of its own; without any other that is an error."""

    def bad():
        raise OSError("no such file\nand more")

    with pytest.raises(ValueError, match="p1: no such file"):
        matrix({"p1": bad})
    with pytest.raises(ValueError, match="no platform"):
        matrix({})


def test_answers_are_whole(spark):
    long = spark.range(2500)
    assert len(tools.many(long, "id")["rows"]) == 2500 and not tools.many(long, "id")["more"]
    page = tools.many(long, "id", limit=10, offset=5)
    assert [r["id"] for r in page["rows"]] == list(range(5, 15)) and page["more"]
    assert not tools.many(long, "id", limit=10, offset=2495)["more"]


def test_builds_are_kept_while_their_tables_stay(spark, tmp_path):
    import shutil

    for t in derived.TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    first = derived.build(spark, str(tmp_path))
    total = first.nodes.agg({"size": "sum"}).first()[0]
    assert derived.build(spark, str(tmp_path)) is first
    fewer = spark.read.parquet(str(tmp_path / "part.parquet")).filter("p_partkey > 20").toPandas()
    fewer.to_parquet(tmp_path / "part.parquet")
    again = derived.build(spark, str(tmp_path))
    assert again is not first and again.nodes.agg({"size": "sum"}).first()[0] < total
    assert Build.stands(again)
