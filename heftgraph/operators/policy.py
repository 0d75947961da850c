"""Module patterns and classes: main, controlled (1st), directly imported (2nd), the rest (3rd)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str | None:
    """Anchored regex of a path glob; * and ? stop at '/', None for a malformed pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += re.escape(pattern[i])
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            neg = body.startswith("^")
            out += "[" + ("^" if neg else "") + re.sub(r"([\[\]\\&^])", r"\\\1", body[neg:]) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches(module: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern holds: 'x/...' is x or below it, 'x...' a prefix, else equality or a glob."""
    hit = F.lit(False)
    for p in (q.strip() for q in patterns):
        if not p:
            continue
        if p.endswith("/..."):
            hit = hit | (module == p[:-4]) | module.startswith(p[:-3])
        elif p.endswith("..."):
            hit = hit | module.startswith(p[:-3])
        else:
            hit = hit | (module == p)
            rx = glob_regex(p)
            if rx:
                hit = hit | module.rlike(rx)
    return hit


@dataclass(frozen=True)
class Policy:
    controlled: tuple[str, ...] = ()
    locked: tuple[str, ...] = ()
    unlock: tuple[str, ...] = ()


def classify(modules: DataFrame, pairs: DataFrame, main: str, policy: Policy) -> DataFrame:
    """module, class, controlled, locked, target, direct_imported of every one of modules(module) but the standard library (''), given the pairs(sm, dm) of modules that import each other."""
    m = F.col("module")
    modules = modules.filter(m != "").select("module").distinct()
    controlled = (m == main) | matches(m, policy.controlled)
    locked = F.when(m == main, True).when(matches(m, policy.unlock), False).when(matches(m, policy.locked), True).otherwise(controlled)
    modules = modules.withColumns({"controlled": controlled, "locked": locked})
    by = F.col("sm")
    direct = pairs.filter((by != "") & ((by == main) | matches(by, policy.controlled))).select(F.col("dm").alias("module")).distinct()
    out = modules.join(direct.withColumn("hit", F.lit(True)), "module", "left").withColumn("direct_imported", F.coalesce("hit", F.lit(False)) & (~F.col("controlled") | ~F.col("locked")))
    kind = F.when(m == main, "main").when(F.col("controlled"), "1st").when(F.col("direct_imported"), "2nd").otherwise("3rd")
    return out.select("module", kind.alias("class"), "controlled", "locked", (F.col("direct_imported") & ~F.col("locked")).alias("target"), "direct_imported")
