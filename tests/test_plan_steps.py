"""The co-prune query follows the whole greedy plan."""

from heftgraph import detail_queries
from test_detail import made


def test_plan_freed_goes_past_five_steps(spark, monkeypatch):
    names = "tuvwxyz"
    sizes = {"app/main": 1, "own/a": 2} | {f"{n}/p": 10 + i for i, n in enumerate(names)}
    g = made(spark, sizes, [("app/main", "own/a"), *(("own/a", f"{n}/p") for n in names)])
    monkeypatch.setattr(detail_queries, "graph", lambda spark, sf: g)
    got = sorted(tuple(r) for r in detail_queries.plan_freed_coprune(spark, "").collect())
    assert got == [(k, n, 17 - k, "") for k, n in enumerate(reversed(names), 1)]
