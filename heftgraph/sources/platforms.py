"""Platforms of a release configuration: given targets, or systems times architectures less what is ignored."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a build covers if it names nothing.
SYSTEMS = ("linux", "darwin", "windows")
ARCHITECTURES = ("amd64", "arm64")


def cells(builds: DataFrame) -> DataFrame:
    """build_id, os, arch of builds(build_id, targets, systems, archs: array<string>, ignore: array<struct<os, arch>>); null counts as empty."""
    given = F.transform("targets", lambda t: F.split(t, "_"))
    given = F.transform(F.filter(given, lambda p: (F.size(p) >= 2) & (p[0] != "") & (p[1] != "")), lambda p: F.struct(p[0].alias("os"), p[1].alias("arch")))
    named = lambda c, usual: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.array(*map(F.lit, usual)))
    all_of = F.flatten(F.transform(named("systems", SYSTEMS), lambda o: F.transform(named("archs", ARCHITECTURES), lambda a: F.struct(o.alias("os"), a.alias("arch")))))
    blank = lambda x: F.coalesce(x, F.lit(""))
    rule = lambda c: lambda r: blank(r["os"]).isin("") & blank(r["arch"]).isin("") | (blank(r["os"]) == c["os"]) & (blank(r["arch"]).isin("") | (blank(r["arch"]) == c["arch"])) | blank(r["os"]).isin("") & (blank(r["arch"]) == c["arch"])
    kept = F.filter(all_of, lambda c: ~F.exists(F.coalesce(F.col("ignore"), F.array().cast("array<struct<os:string,arch:string>>")), rule(c)))
    chosen = F.when(F.coalesce(F.size("targets"), F.lit(0)) > 0, given).otherwise(kept)
    return builds.select("build_id", F.explode(chosen).alias("c")).select("build_id", "c.os", "c.arch")


def parse(label: str) -> tuple[str, str, list[str]]:
    """os, arch and tags of 'os/arch+tag,tag'."""
    m = re.fullmatch(r"([^/+]+)/([^/+]+)(?:\+(.*))?", label.strip())
    if not m:
        raise ValueError(f"not a platform: {label!r}")
    return m[1], m[2], [t.strip() for t in (m[3] or "").split(",") if t.strip()]
