"""Columns that reports show: shares, signed sizes, joined names, kinds, revisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heftgraph.functions.scalars import humanize_bytes, one_decimal

# Fixed values of the reports.
JOINED = 3
COMMIT = 12


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 0 for nothing."""
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / whole.cast("double") * 100)


def signed_bytes(n: Column) -> Column:
    return F.concat(F.when(n < 0, "-").otherwise("+"), humanize_bytes(F.abs(n)))


def join_modules(modules: Column) -> Column:
    """The first three names, and how many more there are."""
    more = F.size(modules) - JOINED
    return F.concat(F.array_join(F.slice(modules, 1, JOINED), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def kind_label(locked: Column, direct: Column) -> Column:
    return F.when(locked, "locked").when(direct, "direct").otherwise("indirect")


def direct_label(direct: Column) -> Column:
    return F.when(direct, "direct").otherwise("transitive")


def short_commit(commit: Column, ref: Column) -> Column:
    """Twelve digits of a hexadecimal commit; another commit as it is; ref if there is none."""
    return F.when(commit.rlike(rf"^[0-9a-f]{{{COMMIT},}}$"), F.substring(commit, 1, COMMIT)).when(commit != "", commit).otherwise(ref)


def percent_text(part: Column, whole: Column) -> Column:
    """A share with one decimal, its exact value rounded half to even."""
    return F.concat(one_decimal(percent(part, whole)), F.lit("%"))


def without_templates(text: Column) -> Column:
    """Template actions become '0'."""
    return F.regexp_replace(text, r"\{\{.*?\}\}", "0")


def snapshot_key(layout: Column, commit: Column, target: Column, tags: Column, env: Column) -> Column:
    """Hash of all that changes a build; tags and variables count in order, once, without blanks."""
    named = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))), ",")
    flat = F.array_join(F.array_sort(F.transform(F.map_entries(env), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    parts = [layout, commit, target, named, flat]
    return F.sha2(F.concat(*(F.concat(p, F.lit("\0")) for p in parts)), 256)
