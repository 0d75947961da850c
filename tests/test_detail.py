"""Single modules and selections: entries, co-prunes, why trees and reference dumps, on made-up graphs."""

import random

import pytest

from heftgraph.operators import entry, session
from heftgraph.operators.policy import Policy
from heftgraph.operators.prune import Graph
from heftgraph.sources import references


def made(spark, sizes, edges, policy=Policy(("own",))):
    pkgs = spark.createDataFrame([(p, p.split("/")[0], s) for p, s in sizes.items()], "pkg string, module string, size long")
    return Graph(pkgs, spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("app/main",)], "pkg string"), "app", policy)


@pytest.fixture(scope="module")
def shop(spark):
    sizes = {"app/main": 1, "own/a": 2, "t/x": 10, "t/y": 20, "u/z": 40, "deep/d": 80, "both/b": 160}
    edges = [("app/main", "own/a"), ("own/a", "t/x"), ("own/a", "t/y"), ("own/a", "u/z"), ("t/x", "deep/d"), ("t/y", "deep/d"), ("t/y", "both/b"), ("u/z", "both/b")]
    return made(spark, sizes, edges)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_entries_part_what_leaves(shop):
    assert rows(entry.entry_weights(shop).select("module", "pkg", "retained")) == [("t", "deep/d", 80), ("t", "t/x", 10), ("t", "t/y", 20), ("u", "u/z", 40)]
    assert rows(shop.exclusive_freed().select("module", "freed_bytes")) == [("t", 110), ("u", 40)]


def test_marginals(shop):
    assert rows(session.marginals(shop, [])) == [("t", 110), ("u", 40)]
    assert rows(session.marginals(shop, ["t"])) == [("t", 0), ("u", 200)]


def test_plan_names_what_it_needs(shop):
    assert rows(session.plan_freed(shop, ["t", "u"])) == [(1, "deep", 80, ""), (1, "t", 30, ""), (2, "both", 160, "t"), (2, "u", 40, "")]


def test_drag_out(shop):
    assert rows(session.drag_out(shop, "t").select("module", "bytes", "freed", "needed_by")) == [("both", 160, False, "u"), ("deep", 80, True, "")]


def test_why_stops_at_own_code_and_counts_the_rest(shop):
    assert [r[1:] for r in rows(session.import_why(shop)) if r[0] == "both"] == [(0, "both", -1, 0), (1, "t", 0, 0), (2, "u", 0, 0), (3, "own", 1, 0)]
    assert [r[1:] for r in rows(session.import_why(shop, 8, 1)) if r[0] == "both"] == [(0, "both", -1, 1), (1, "t", 0, 0), (2, "own", 1, 0)]


def test_dominators_against_removal():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 14)
        succ = [sorted({r.randrange(n) for _ in range(r.randint(0, 3))}) for _ in range(n)]

        def seen(without, succ=succ):
            got, todo = set(), [] if without == 0 else [0]
            while todo:
                v = todo.pop()
                if v not in got and v != without:
                    got.add(v)
                    todo.extend(succ[v])
            return got

        order, idom = entry.immediate(succ)
        assert set(order) == seen(None)
        over = {v: {d for d in order if d != v and v not in seen(d)} for v in order}
        for v in order[1:]:
            assert over[idom[v]] | {idom[v]} == over[v]


def test_a_larger_graph_is_walked_by_joins(shop):
    columns = ("node", "kind", "module", "idom", "retained")
    assert rows(entry.dominator_tree(shop, 3).select(*columns)) == rows(entry.dominator_tree(shop).select(*columns))


def test_dominators_by_rounds(spark):
    """Drawn graphs with cycles and nodes out of reach: the same as what removal of each node shows."""
    for seed in (1, 2):
        r = random.Random(seed)
        nodes = [f"n{i}" for i in range(14)]
        edges = {("", "n0"), ("", "n3")} | {(r.choice(nodes), r.choice(nodes)) for _ in range(26)}

        def seen(without):
            got, todo = set(), [""]
            while todo:
                v = todo.pop()
                if v not in got and v != without:
                    got.add(v)
                    todo += [d for s, d in edges if s == v]
            return got

        live = seen(None)
        want = sorted((v, d) for v in live for d in live if d == v or v not in seen(d))
        assert rows(entry.dominators(spark.createDataFrame(sorted(edges), "src string, dst string"))) == want


def test_a_round_of_dominators_passes_two_numbers_an_edge(spark, monkeypatch):
    """Dominators are told by few rounds over the edges, with chains of a graph with hubs and cycles as removal shows them."""
    r = random.Random(5)
    edges = {(entry.START, 1), (entry.START, 4)} | {(r.randrange(16), r.randrange(16)) for _ in range(40)}
    frame = spark.createDataFrame([(s, d, s % 2) for s, d in sorted(edges)], "src long, dst long, hub int")

    def seen(without):
        got, todo = set(), [entry.START]
        while todo:
            v = todo.pop()
            if v not in got and v != without:
                got.add(v)
                todo += [d for s, d in edges if s == v]
        return got

    live = seen(None)
    over = {v: {d for d in live if d == v or v not in seen(d)} for v in live}
    got = {x["node"]: x["chain"] for x in entry.dominator_chains(frame).collect()}
    assert got == {v: sorted(over[v], key=lambda d: len(over[d])) for v in live}


def test_reference_dump(spark, shop):
    lines = ["# own/a.F -> t/x.G", "", "own/a.F -> t/x.(*T).G", "main.main -> own/a.F", "u/z.F.stkobj -> type:int", "no arrow", "far/q.F -> t/x.G -> u/z.F"]
    live = references.live_packages(spark.createDataFrame([(x,) for x in lines], "value string"), shop.packages.select("pkg"), "app/main")
    assert rows(live) == [("app/main",), ("own/a",), ("t/x",)]
    assert rows(references.narrowed(shop.edges, live, shop.roots)) == [("app/main", "own/a"), ("own/a", "t/x")]
    assert rows(references.narrowed(shop.edges, live.limit(0), shop.roots)) == rows(shop.edges)
