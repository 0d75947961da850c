"""Scalar functions as Column expressions, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATED = "<generated>"


def symbol_package(name: Column) -> Column:
    """Package of a linker symbol: the text before the first '.' after the last '/'; others are generated."""
    raw = F.regexp_extract(name, r"^((?:.*/)?[^./]*)\.", 1)
    whole = F.replace(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    plain = F.coalesce(F.try_url_decode(whole), raw)
    return F.when((raw == "") | raw.contains(":") | raw.startswith("_"), GENERATED).otherwise(plain)


def is_aux_symbol(name: Column) -> Column:
    return name.rlike(r"\.(argliveinfo|args_stackmap|stkobj|opendefer|arginfo[0-9]+)$")


def one_decimal(x: Column) -> Column:
    """x (0 <= x < 2048, a double) with one decimal, its exact binary value rounded half to even."""
    scaled = (x * float(1 << 52)).cast("long").cast("decimal(20,0)") * 10
    whole = F.floor(scaled / (1 << 52)).cast("long")
    rest = (scaled - whole.cast("decimal(20,0)") * (1 << 52)).cast("long")
    tenth = whole + F.when((rest > 1 << 51) | ((rest == 1 << 51) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenth / 10).cast("string"), F.lit("."), (tenth % 10).cast("string"))


def humanize_bytes(n: Column) -> Column:
    """SI units with one decimal; below 1000 exact."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((3, "kB"), (6, "MB"), (9, "GB")):
        out = F.when(n >= 10**power, F.concat(one_decimal(n.cast("double") / 10**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n >= 10**12, F.format_string("%.1f TB", n.cast("double") / 10**12)).otherwise(out)


def parse_bytes(text: Column) -> Column:
    """Inverse of humanize_bytes, in doubles and cut to whole bytes; an error for what isn't a size, null for null."""
    rx = r"^([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*([KMGT]?B)$"
    t = F.upper(F.trim(text))
    number, unit = F.regexp_extract(t, rx, 1), F.regexp_extract(t, rx, 2)
    factor = F.when(unit == "B", 1).when(unit == "KB", 10**3).when(unit == "MB", 10**6).when(unit == "GB", 10**9).when(unit == "TB", 10**12)
    return F.when(number != "", (number.cast("double") * factor).cast("long")).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a size: "), text)).cast("long"))


def version_key(v: Column) -> Column:
    """Sortable struct of a language or release version; null for '' and lowest of all.

    A bare version from minor 21 on lies below its prereleases and releases.
    """
    rx = r"^(\d+)\.(\d+)(?:\.(\d+))?(?:(beta|rc)(\d+))?$"
    part = lambda k: F.when(F.regexp_extract(v, rx, k) != "", F.regexp_extract(v, rx, k))
    minor = part(2).cast("int")
    kind = F.when(part(4) == "beta", 1).when(part(4) == "rc", 2).when(part(3).isNull() & (minor >= 21), 0).otherwise(3)
    return F.when(v != "", F.struct(part(1).cast("int").alias("major"), minor.alias("minor"), kind.alias("kind"), F.coalesce(part(3).cast("int"), F.lit(0)).alias("patch"), F.coalesce(part(5).cast("int"), F.lit(0)).alias("pre")))


def package_alias(path: Column) -> Column:
    """Default import name: the last path element, or the one before a version suffix."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    return F.when(last.rlike("^v[0-9]+$") & (F.size(parts) >= 2), F.element_at(parts, -2)).otherwise(last)


def short_module(module: Column) -> Column:
    return F.when(module == "", "main").otherwise(F.substring_index(module, "/", -1))


def effort(prize: Column, freed: Column, potential: Column, pinned: Column, sites: Column, many: int = 20) -> Column:
    """How a target's prize can be had; conditions in order of precedence."""
    held = pinned & (prize > freed)
    latent = (freed == 0) & (prize > 0)
    return F.when(held, "pinnedByDep").when((freed == 0) & (potential > 0), "coordinated").when(latent, "pinnedByDep").when(sites >= many, "core").otherwise("quickWin")


def platform_label(os: Column, arch: Column, tags: Column) -> Column:
    """os/arch and, after '+', the sorted distinct tags; blanks stand for the host."""
    host = lambda c: F.when(c == "", "host").otherwise(c)
    named = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))), ",")
    return F.concat(host(os), F.lit("/"), host(arch), F.when(named != "", F.concat(F.lit("+"), named)).otherwise(""))
