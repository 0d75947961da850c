"""The graph operators against plain sets and recursion, on drawn graphs, in both ways of sweeping."""

import random
from itertools import combinations, permutations

import pytest

from heftgraph.operators import session
from heftgraph.operators.policy import Policy
from heftgraph.operators.prune import Graph
from heftgraph.operators.reports import diff, floor

POLICY = Policy(controlled=("ours/...", "m2"), locked=("m4", "m5/..."), unlock=("m2",))


class Drawn:
    """A random graph: modules of one to three packages, main, two controlled ones, a standard library, unlisted names."""

    def __init__(self, seed, modules=9):
        r = random.Random(seed)
        names = ["home", "ours/a", "ours/b", *(f"m{i}" for i in range(modules))]
        self.module = {f"{m}/p{k}": m for m in names for k in range(1 if m == "home" else r.randint(1, 3))}
        self.module |= {"fmt": "", "os": ""}
        self.size = {p: r.choice([0, 1, 7, 30, 200]) for p in self.module}
        nodes = list(self.module)
        self.edges = {("home/p0", p) for p in nodes if p.startswith("ours/")}
        for p in nodes:
            for q in r.sample(nodes, 3):
                if p != q and not (p in ("fmt", "os") and self.module[q]) and r.random() < 0.6:
                    self.edges.add((p, q))
        self.edges |= {("ours/a/p0", "unlisted"), ("unlisted", "m0/p0")}
        self.module["unlisted"], self.size["unlisted"] = "", 0

    def graph(self, spark, small=True):
        rows = [(p, m, self.size[p]) for p, m in self.module.items() if p != "unlisted"]
        pkgs = spark.createDataFrame(rows, "pkg string, module string, size long")
        return Graph(pkgs, spark.createDataFrame(sorted(self.edges) * 2, "src string, dst string"), spark.createDataFrame([("home/p0",)], "pkg string"), "home", POLICY, small)

    # the rules, spelt out
    def controlled(self, m):
        return m == "home" or m.startswith("ours/") or m == "m2"

    def locked(self, m):
        return m == "home" or (m != "m2" and (m == "m4" or m == "m5" or self.controlled(m)))

    @property
    def targets(self):
        direct = {self.module[d] for s, d in self.edges if self.controlled(self.module[s]) and self.module[d] not in ("", self.module[s])}
        return sorted(m for m in direct if not self.locked(m))

    def reach(self, gone=(), prize=None, starts=("home/p0",)):
        seen, todo = set(), list(starts)
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            for s, d in self.edges:
                cut = self.controlled(self.module[s]) and self.module[d] in gone
                outer = prize and self.module[d] == prize != self.module[s]
                if s == p and not cut and not outer:
                    todo.append(d)
        return seen

    def freed(self, gone):
        return self.reach() - self.reach(gone)

    def bytes(self, pkgs):
        return sum(self.size[p] for p in pkgs)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module", params=[(26, True), (29, True), (29, False)], ids=["a", "b", "b-joins"])
def both(request, spark):
    seed, small = request.param
    d = Drawn(seed)
    assert len(d.targets) >= 3
    return d, d.graph(spark, small)


def test_targets_and_classes(both):
    d, g = both
    got = {r["module"]: r for r in g.classes.collect()}
    assert set(got) == {m for m in d.module.values() if m}
    assert all(r["locked"] == d.locked(m) and r["controlled"] == d.controlled(m) for m, r in got.items())
    assert [r[0] for r in rows(g.targets, "target")] == d.targets


def test_what_leaves(both):
    d, g = both
    base = d.reach()
    assert rows(g.base, "pkg", "module", "size") == sorted((p, d.module[p], d.size[p]) for p in base)
    assert rows(g.exclusive_freed(), "module", "freed_bytes", "freed_packages") == [(t, d.bytes(d.freed({t})), len(d.freed({t}))) for t in d.targets]
    assert rows(g.exclusive, "cut_id", "pkg") == sorted((t, p) for t in d.targets for p in d.freed({t}))
    assert rows(g.prize(), "module", "prize_bytes") == [(t, d.bytes(base - d.reach(prize=t))) for t in d.targets]
    freeable = base - d.reach(set(d.targets))
    closure = {t: d.reach(starts=[p for p, m in d.module.items() if m == t]) for t in d.targets}
    assert rows(g.closures, "target", "pkg") == sorted((t, p) for t, c in closure.items() for p in c)
    want = [(t, d.bytes(freeable & closure[t]), d.bytes(freeable & closure[t]) - d.bytes(d.freed({t}))) for t in d.targets]
    assert rows(g.potential(), "module", "potential_bytes", "shared_bytes") == want
    shared = {}
    for t in d.targets:
        for p in (freeable & closure[t]) - d.freed({t}):
            held = shared.setdefault((t, d.module[p] or "std"), [0, set()])
            held[0] += d.size[p]
            held[1] |= {o for o in d.targets if o != t and p in closure[o]}
    assert rows(g.shared_with(), "module", "holder", "bytes", "also_via") == sorted((t, h, b, ",".join(sorted(v))) for (t, h), (b, v) in shared.items() if b)
    whole = [(t, m) for t in d.targets for m in set(d.module.values()) - {""} if (own := {p for p in base if d.module[p] == m}) and own <= d.freed({t})]
    assert rows(g.freed_modules(), "module", "freed_module") == sorted(whole)


def test_pins_and_importers(both):
    d, g = both
    pins = {}
    for s, e in d.edges:
        a, b = d.module[s], d.module[e]
        if a and a != b and b in d.targets and d.locked(a) and not d.controlled(a):
            pins.setdefault(b, set()).add(a)
    assert rows(g.pinned_by(), "module", "pinned_by") == sorted((m, ",".join(sorted(x))) for m, x in pins.items())
    base, into = d.reach(), {}
    for s, e in d.edges:
        if s in base and e in base and d.module[e] and d.module[s] != d.module[e]:
            into.setdefault(d.module[e], set()).add(d.module[s])
    assert rows(g.fan_in(), "module", "importers") == sorted((m, len(x)) for m, x in into.items())


def greedy(d):
    chosen, out, total = [], [], 0
    while True:
        best = max(((d.bytes(d.freed({*chosen, t})), t) for t in reversed(d.targets) if t not in chosen), key=lambda x: x[0], default=(0, ""))
        if best[0] <= total:
            return out
        own = sum(d.size[p] for p in d.freed({*chosen, best[1]}) - d.freed(chosen) if d.module[p] == best[1])
        chosen.append(best[1])
        out.append((len(chosen), best[1], best[0] - total, best[0], own))
        total = best[0]


def test_plan(both):
    d, g = both
    assert rows(g.plan_steps(), "step", "module", "marginal", "cumulative", "own_bytes") == greedy(d)


def units(d, gone):
    out = {}
    for p in d.freed(gone):
        unit = d.module[p] or p
        out[unit] = out.get(unit, 0) + d.size[p]
    return out


def test_plan_names_what_each_step_needs(both):
    d, g = both
    plan = [r[1] for r in greedy(d)]
    want = []
    for k, best in enumerate(plan, 1):
        now, before, alone = units(d, set(plan[:k])), units(d, set(plan[: k - 1])), units(d, {best})
        for u, b in now.items():
            if b > before.get(u, 0):
                need = [] if u in alone else sorted(o for o in plan[: k - 1] if u not in units(d, set(plan[:k]) - {o}))
                want.append((k, u, b - before.get(u, 0), ",".join(need)))
    assert rows(session.plan_freed(g, plan), "step", "unit", "bytes", "co_prune") == sorted(want)


def test_marginals(both):
    d, g = both
    for chosen in ([], d.targets[:1], d.targets[:2]):
        v = d.bytes(d.freed(set(chosen)))
        assert rows(session.marginals(g, chosen), "module", "marginal") == [(t, d.bytes(d.freed({*chosen, t})) - v) for t in d.targets]


def test_fair_shares(both):
    d, g = both
    names, total = d.targets, {t: 0 for t in d.targets}
    value = {frozenset(c): d.bytes(d.freed(set(c))) for k in range(len(names) + 1) for c in combinations(names, k)}
    orders = list(permutations(names)) if len(names) <= 6 else None
    if orders is None:
        pytest.skip("too many orders")
    for o in orders:
        for k, t in enumerate(o):
            total[t] += value[frozenset(o[: k + 1])] - value[frozenset(o[:k])]
    n = len(orders)
    assert rows(g.shapley(), "module", "blame", "alone", "exact") == [(t, (2 * total[t] + n) // (2 * n), value[frozenset([t])], True) for t in names]
    sampled = {r["module"]: r["blame"] for r in g._sampled(names).collect()}
    assert set(sampled) == set(names)
    assert abs(sum(sampled.values()) - value[frozenset(names)]) <= len(names)
    assert all(abs(sampled[t] - total[t] / n) <= 0.15 * value[frozenset(names)] + 1 for t in names)


def test_selections(both):
    d, g = both
    gone = set(d.targets[:2])
    freed, base = d.freed(gone), d.reach()
    assert rows(g.what_if([*gone, "no-target"]), "original_size", "freed_bytes", "projected_size") == [(d.bytes(base), d.bytes(freed), d.bytes(base) - d.bytes(freed))]
    own, total = {}, {}
    for p in base:
        total[d.module[p]] = total.get(d.module[p], 0) + d.size[p]
        if p in freed:
            own[d.module[p]] = own.get(d.module[p], 0) + d.size[p]
    assert rows(g.freed_list(sorted(gone)), "module", "bytes", "whole") == sorted((m, b, bool(m) and 0 < total[m] <= b) for m, b in own.items())


def test_floor_and_diff(spark):
    m = spark.createDataFrame([("g", "home", "1.20", True), ("g", "x", "1.25.1", False), ("g", "y", "1.25.1", False), ("g", "z", "1.25rc1", False), ("g", "w", "", False)], "graph_id string, module string, version string, owned boolean")
    assert rows(floor(m), "version", "critical", "next_version", "owned_max") == [("1.25.1", "x,y", "1.25rc1", "1.20")]
    s = "module string, size long"
    before, after = spark.createDataFrame([("home", 1), ("a", 5), ("b", 6), ("c", 7)], s), spark.createDataFrame([("home", 2), ("a", 5), ("b", 4), ("d", 9)], s)
    assert rows(diff(before, after, "home"), "module", "status", "delta") == [("b", "changed", -2), ("c", "removed", -7), ("d", "added", 9)]


def test_joins_follow_an_edge_once_for_all_cuts(spark, tmp_path, monkeypatch):
    """More cuts than a word has bits; the rows of a round don't grow with the cuts."""
    from heftgraph.operators import reach as module

    d = Drawn(29)
    g = d.graph(spark, False)
    chosen = [(f"c{k}", t) for k in range(70) for t in (d.targets[k % len(d.targets)], None)]
    assert g.base.count() and g.hops.count()
    monkeypatch.setattr(module, "root", lambda spark: tmp_path.as_uri())
    freed = {r["cut_id"]: r["bytes"] for r in g.freed_by(spark.createDataFrame(chosen, "cut_id string, target string")).collect()}
    assert freed == {c: d.bytes(d.freed({t})) for c, t in chosen if t}
    (path,) = [p for p in tmp_path.iterdir() if p.name.startswith("reached-")]
    assert spark.read.parquet(str(path / "round=1")).count() <= 2 * len(d.module)


def test_many_cuts_take_one_walk(spark, monkeypatch):
    """What cuts free follows from the entries that they leave open, not from a walk a cut; beyond the bound each is walked."""
    from heftgraph.operators import entries, prune

    d = Drawn(29)
    g = d.graph(spark, False)
    chosen = {str(k): gone for k, gone in enumerate([t for n in range(len(d.targets) + 1) for t in combinations(d.targets, n)])}
    cuts = spark.createDataFrame([(k, t) for k, gone in chosen.items() for t in (gone or (None,))], "cut_id string, target string")
    want = {k: (d.bytes(d.freed(gone)), len(d.freed(gone))) for k, gone in chosen.items()}
    walks = []
    walk = entries.reach_bits
    monkeypatch.setattr(entries, "reach_bits", lambda *a: walks.append(a) or walk(*a))
    monkeypatch.setattr(prune, "reach_bits", lambda *a: 1 / 0)
    assert {r["cut_id"]: (r["bytes"], r["packages"]) for r in g.freed_by(cuts).collect()} == want
    assert {(r["cut_id"], r["module"]): r["bytes"] for r in g.freed_sums(cuts, "module").collect()}.keys() == {(k, d.module[p]) for k, gone in chosen.items() for p in d.freed(gone)}
    assert len(walks) == 1
    monkeypatch.setattr(prune, "reach_bits", walk)
    monkeypatch.setattr(prune, "MOST_ENTRIES", 1)
    few = cuts.filter("cut_id < '2'")
    assert {r["cut_id"]: (r["bytes"], r["packages"]) for r in d.graph(spark, False).freed_by(few).collect()} == {k: v for k, v in want.items() if k < "2"}


def test_hubs_are_walked_apart(spark, monkeypatch):
    """The edges of hubs are read in the rounds alone that reach one; results are those of plain sets, however many are hubs."""
    from heftgraph.operators import build, reach

    d = Drawn(29)
    for hub in (1, 3):
        monkeypatch.setattr(build, "HUB", hub)
        g = d.graph(spark, False)
        degree = {p: sum(s == p for s, _ in d.edges) for p in d.module}
        assert {r["src"] for r in g.build.links.filter("hub = 1").collect()} == {p for p, n in degree.items() if n >= hub}
        assert rows(g.base, "pkg") == sorted((p,) for p in d.reach())
        assert rows(g.exclusive_freed(), "module", "freed_bytes") == sorted((t, d.bytes(d.freed({t}))) for t in d.targets)
        assert rows(g.prize(), "module", "prize_bytes") == sorted((t, d.bytes(d.reach() - d.reach(prize=t))) for t in d.targets)
    edges = spark.createDataFrame([(3, 5, 1), (5, 2, 1), (2, 4, 0)], "src long, dst long, hub int")
    one = lambda n: spark.createDataFrame([(n, 0, 1)], "node long, word int, bits long")
    assert [rows(e, "src") for _, e in reach.fronts(one(2), edges)] == [[(2,)]]
    assert rows(reach.reach_bits(edges, one(3)), "node") == [(2,), (3,), (4,), (5,)]


def test_prizes_and_breakdowns_take_the_walk_of_the_entries(spark, monkeypatch):
    """One walk tells what is freed, of which units; prizes take one more where other edges lead into targets."""
    from heftgraph.operators import entries, prune

    d = Drawn(29)
    g = d.graph(spark, False)
    walks, walk = [], entries.reach_bits
    monkeypatch.setattr(entries, "reach_bits", lambda *a: walks.append(a) or walk(*a))
    monkeypatch.setattr(prune, "reach_bits", lambda *a: 1 / 0)
    want = {}
    for t in d.targets:
        for p in d.freed({t}):
            key = (t, d.module[p] or p, not d.module[p])
            want[key] = want.get(key, 0) + d.size[p]
    assert rows(g.freed_breakdown(), "module", "unit", "is_std", "bytes") == sorted((*k, b) for k, b in want.items())
    assert rows(g.prize(), "module", "prize_bytes") == sorted((t, d.bytes(d.reach() - d.reach(prize=t))) for t in d.targets)
    assert len(walks) == 2
