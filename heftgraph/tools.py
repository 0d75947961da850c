"""Tools: questions with arguments and answers as JSON, over one analysis or several."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heftgraph.analysis import Analysis, matrix
from heftgraph.operators import reports
from heftgraph.operators.budget import Budget


def _plain(x):
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return {str(k): _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def one(df: DataFrame) -> dict:
    return _plain(df.first())


def many(df: DataFrame, *by: str | Column, limit: int | None = None, offset: int = 0) -> dict:
    """All rows in order, or limit of them from offset on; 'more' tells whether there are others behind."""
    ordered = df.orderBy(*by)
    if offset:
        ordered = ordered.offset(offset)
    got = ordered.collect() if limit is None else ordered.limit(limit + 1).collect()
    return {"rows": [_plain(r) for r in got[:limit]], "more": limit is not None and len(got) > limit}


def anatomy(a: Analysis) -> dict:
    return one(a.size.drop("path")) | {"main_module": a.main, "sections": many(a.sections(), F.desc("size"), "name"), "modules": many(a.size_modules(), "place")}


def size_targets(a: Analysis) -> dict:
    """Candidates by prize, who shares and holds what, and a plan."""
    shared = many(a.graph.shared_with(), "module", F.desc("bytes"), "holder")
    entries = many(a.entry_prizes(), "module", F.desc("retained"), "pkg")
    return {"accounted_size": one(a.size)["accounted_size"], "main_module": a.main, "candidates": many(a.candidates(), F.desc("prize_bytes"), "module"), "shared_with": shared, "entries": entries, "plan": many(a.graph.plan_steps(), "step")}


def go_floor(a: Analysis) -> dict:
    found = a.floor()
    return one(found) | {"action": one(reports.verdict(found))}


def locate_cuts(a: Analysis, module: str) -> dict:
    parts = a.inspect(module)
    by = {"entries": (F.desc("retained"), "pkg"), "drags": (F.desc("bytes"), "module"), "sites": ("path", "line"), "why": ("place",)}
    return one(parts["summary"]) | {k: many(v, *by[k]) for k, v in parts.items() if k != "summary"}


def measure(a: Analysis) -> dict:
    return one(a.measure())


def diff(a: Analysis, before: Analysis) -> dict:
    parts = a.diff(before)
    return {"modules": many(parts["modules"], F.desc(F.abs("delta")), "module"), "totals": many(parts["totals"], "status"), "floor": one(parts["floor"])}


def check(a: Analysis, limits: Budget, on_disk: bool = False) -> dict:
    broken, verdict = a.check(limits, on_disk)
    return one(verdict) | {"violations": many(broken, "rule", "module", "limit")}


def platform_matrix(cells: dict[str, Analysis | Callable[[], Analysis]]) -> dict:
    parts = matrix(cells)
    return {"modules": many(parts["modules"], "place"), "cells": many(parts["cells"], "label"), "floor": one(parts["floor"]), "failed": many(parts["failed"], "label")}


TOOLS: dict[str, Callable[..., dict]] = {"anatomy": anatomy, "size_targets": size_targets, "go_floor": go_floor, "locate_cuts": locate_cuts, "measure": measure, "diff": diff, "check": check, "matrix": platform_matrix}
