"""Budgets: caps on sizes and versions, denied modules, and what breaks them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heftgraph.functions.scalars import humanize_bytes, version_key
from heftgraph.operators.policy import matches

UNITS = {"B": 0, "KB": 3, "MB": 6, "GB": 9, "TB": 12}


def parse_size(text: str) -> int:
    """Bytes of a size such as '1.5 MB'; an error for anything else."""
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*([a-z]+)", text.strip(), re.I)
    if not m or m[2].upper() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 10 ** UNITS[m[2].upper()])


@dataclass(frozen=True)
class Budget:
    """Limits as given; sizes are checked when the budget is made. Exactly at a limit passes."""

    max_size: str = ""
    max_version: str = ""
    deny: Sequence[str] = ()
    module_caps: Mapping[str, str] = field(default_factory=dict)
    action: str = "fail"

    def __post_init__(self):
        object.__setattr__(self, "action", self.action.strip().lower() or "fail")
        if self.action not in ("fail", "warn"):
            raise ValueError(f"not an action: {self.action!r}")
        for text in (*([self.max_size] if self.max_size.strip() else []), *self.module_caps.values()):
            parse_size(text)

    @property
    def configured(self) -> bool:
        return bool(self.max_size.strip() or self.max_version.strip() or self.deny or self.module_caps)


def first_match(patterns: Sequence[str], module: Column) -> Column:
    """The first pattern that a module matches, null for none."""
    return F.coalesce(*(F.when(matches(module, [p]), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def violations(gated: DataFrame, floor: DataFrame, modules: DataFrame, budget: Budget, label: str = "stripped binary") -> DataFrame:
    """rule, module, limit, actual, action, message of every broken rule.

    gated(bytes) is the size that the cap on the whole holds for, floor(version) the floor, and
    modules(module, size, in_build) what the other rules are about.
    """
    columns = ["rule", "module", "limit", "actual", "message"]
    text = F.lit("").cast("string")
    out = modules.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in columns))

    def rows(df: DataFrame, rule: str, module: Column, limit: Column, actual: Column, message: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), module.alias("module"), limit.alias("limit"), actual.alias("actual"), message.alias("message"))

    if budget.max_size.strip():
        limit, size = budget.max_size.strip(), humanize_bytes(F.col("bytes"))
        over = gated.filter(F.col("bytes") > parse_size(limit))
        out = out.union(rows(over, "max-binary-size", text, F.lit(limit), size, F.concat(F.lit(f"{label} is "), size, F.lit(f", over the {limit} budget"))))
    if budget.max_version.strip():
        limit = budget.max_version.strip()
        over = floor.filter((F.col("version") != "") & (version_key(F.col("version")) > version_key(F.lit(limit))))
        out = out.union(rows(over, "max-go-version", text, F.lit(limit), F.col("version"), F.concat(F.lit("floor is "), F.col("version"), F.lit(f", over the {limit} budget"))))
    held = modules.filter("in_build")
    m = F.col("module")
    if budget.deny:
        hit = held.withColumn("p", first_match(budget.deny, m)).filter("p is not null")
        out = out.union(rows(hit, "deny", m, F.col("p"), F.lit("present"), F.concat(F.lit("denied module "), m, F.lit(" is in the build, by "), F.col("p"))))
    if budget.module_caps:
        caps = F.array(*(F.struct(F.lit(v.strip()).alias("limit"), F.lit(parse_size(v)).cast("long").alias("bytes"), matches(m, [p]).alias("hit")) for p, v in budget.module_caps.items()))
        over = held.select("module", "size", F.explode(F.filter(caps, lambda c: c["hit"] & (F.col("size") > c["bytes"]))).alias("c"))
        size = humanize_bytes(F.col("size"))
        out = out.union(rows(over, "max-module-size", m, F.col("c.limit"), size, F.concat(m, F.lit(" is "), size, F.lit(", over its "), F.col("c.limit"), F.lit(" cap"))))
    return out.withColumn("action", F.lit(budget.action))


def verdict(broken: DataFrame, budget: Budget) -> DataFrame:
    """passes, fails, warnings, configured: a broken rule under 'warn' doesn't fail."""
    fails = F.count_if(F.col("action") == "fail")
    return broken.agg((fails == 0).alias("passes"), fails.alias("fails"), F.count_if(F.col("action") == "warn").alias("warnings")).withColumn("configured", F.lit(budget.configured))
