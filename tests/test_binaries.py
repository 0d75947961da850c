"""Readers of executables on small files of each format, attribution, budgets, prefixes, sources and orders."""

import duckdb
import pytest
from pyspark.sql import functions as F

from heftgraph import queries, report_queries  # noqa: F401
from heftgraph.operators import anatomy, budget, order, prefix
from heftgraph.plans import executables as made
from heftgraph.sources import binaries, imports, modules

SF = "/root/testdata/sf0.001"
FUNCTIONS = [("a/b.F", 16), ("c.Empty", 0), ("d%2ex/y.H", 32)]
TABLE = made.line_table(FUNCTIONS, 0x1000)
INFO = made.build_info("linux", "arm64", "x/cmd", "x")
NAMES = {"elf": (".text", ".data", ".bss", ".gopclntab"), "mach": ("__TEXT __text", "__DATA __data", "__DATA __bss", "__TEXT __gopclntab"), "pe": (".text", ".data", ".bss", ".rdata")}


def executable(kind, symbols=()):
    text, data, zero, table = NAMES[kind]
    first = kind == "elf"
    parts = [(text, 20_000, True, b""), (data, len(INFO) + 64, True, INFO), (zero, 40, False, b""), (table, len(TABLE), True, TABLE)]
    return getattr(made, kind)(parts, [(n, s + first, a) for n, s, a in symbols])


@pytest.mark.parametrize("kind", ["elf", "mach", "pe"])
def test_formats(kind):
    raw = executable(kind, [("a/b.F", 0, 0), ("a.long.name/of.G", 0, 16), ("c.v", 1, 8)])
    found = binaries.image(raw)
    first = kind == "elf"
    assert found.symbols == [(first, 0, "a/b.F"), (first, 16, "a.long.name/of.G"), (1 + first, 8, "c.v")]
    own = [s for s in found.sections if s[0] in NAMES[kind]]
    assert [(s[2], s[3], s[4]) for s in own] == [(20_000, True, True), (len(INFO) + 64, True, False), (40, False, False), (len(TABLE), True, False)]
    assert own[3][5] == (kind != "pe")
    assert binaries.functions(found.table, found.text) == [f for f in FUNCTIONS if f[1]]
    assert binaries.build_facts(raw) == {"system": "linux", "arch": "arm64", "main_package": "x/cmd", "main_module": "x"}


def test_unknown_and_broken_files():
    for raw in (b"", b"#!/bin/sh\n", b"PK\3\4" + b"0" * 100):
        with pytest.raises(ValueError):
            binaries.image(raw)
    with pytest.raises(ValueError):
        binaries.image(made.pe([(".text", 64, True, b"")], []))
    with pytest.raises(ValueError):
        binaries.functions(b"0" * 64, 0)


def test_files_are_read_from_a_folder(spark, tmp_path):
    symbols = [(f"m/p{k % 3}.F{k}", 0, 16 * k) for k in range(600)]
    for kind in NAMES:
        (tmp_path / kind).write_bytes(executable(kind, symbols))
        (tmp_path / f"{kind}-stripped").write_bytes(executable(kind))
    files = binaries.read(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    rows = {(r["path"], r["pkg"]): (r["bytes"], r["code_bytes"]) for r in anatomy.packages(files).collect()}
    code = 600 * 16 + 20_000 - 600 * 16
    own = [sum(1 for k in range(600) if k % 3 == j) * 16 + (20_000 - 600 * 16 if j == 599 % 3 else 0) for j in range(3)]
    assert sum(own) == code
    for j in range(3):
        assert rows["pe", f"m/p{j}"] == (own[j], own[j])
        assert rows["elf", f"m/p{j}"] == (own[j] + len(TABLE) * own[j] // code, own[j])
    for kind in NAMES:
        assert rows[f"{kind}-stripped", "a/b"] == (16, 16) and rows[f"{kind}-stripped", "d.x/y"] == (32, 32)


@pytest.mark.parametrize("name", ["binary_symbols", "binary_packages", "size_modules", "symbol_module", "source_coupling", "inspect_sites", "matrix_module_rows"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "customer", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_budgets(spark):
    assert [budget.parse_size(t) for t in ("0B", "1.5 kB", "2mb", ".5 GB", "1 TB")] == [0, 1500, 2_000_000, 500_000_000, 10**12]
    for bad in ("", "5", "-1 MB", "1 MiB", "x MB"):
        with pytest.raises(ValueError):
            budget.parse_size(bad)
    with pytest.raises(ValueError):
        budget.Budget(action="stop")
    with pytest.raises(ValueError):
        budget.Budget(module_caps={"a": "much"})
    m = spark.createDataFrame([("a", 1000, True), ("b/c", 2000, True), ("b/d", 9000, False)], "module string, size long, in_build boolean")
    size, floor = spark.createDataFrame([(3000,)], "bytes long"), spark.createDataFrame([("1.24.1",)], "version string")
    strict = budget.Budget("2999 B", "1.24.0", ("b/...", "*/c"), {"a": "1 kB", "b/...": "1.9 kB"}, "warn")
    broken = budget.violations(size, floor, m, strict)
    assert sorted((r["rule"], r["module"], r["limit"], r["actual"]) for r in broken.collect()) == [("deny", "b/c", "b/...", "present"), ("max-binary-size", "", "2999 B", "3.0 kB"), ("max-go-version", "", "1.24.0", "1.24.1"), ("max-module-size", "b/c", "1.9 kB", "2.0 kB")]
    assert [tuple(r) for r in budget.verdict(broken, strict).collect()] == [(True, 0, 4, True)]
    exact = budget.Budget("3 kB", "1.24.1")
    assert budget.violations(size, floor, m, exact).count() == 0
    none = spark.createDataFrame([("",)], "version string")
    assert budget.violations(size, none, m, budget.Budget(max_version="1.1")).count() == 0
    assert not budget.Budget().configured


def test_prefixes_and_places(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a",), ("z/q",), ("listed/std",)], "p string")
    mods = spark.createDataFrame([("a",), ("a/b",), ("",), ("listed",)], "module string")
    listed = spark.createDataFrame([("listed/std", ""), ("a/bc", "other")], "pkg string, module string")
    assert sorted(map(tuple, prefix.owners(paths, "p", listed, mods).collect())) == [("a", "a"), ("a/b/c", "a/b"), ("a/bc", "other"), ("listed/std", ""), ("z/q", "")]
    df = spark.createDataFrame([(f"m{k}", (k * 7) % 50) for k in range(200)], "module string, size long").repartition(6)
    got = sorted(map(tuple, order.ranked(df, order.named("size")).select("place", "size", "module").collect()))
    want = sorted(((s, m) for m, s in map(tuple, df.collect())), key=lambda x: (-x[0], x[1]))
    assert got == [(k, s, m) for k, (s, m) in enumerate(want, 1)]
    assert order.ranked(df.filter("false"), order.named("name")).count() == 0


def test_listings_of_any_spacing(spark, tmp_path):
    one = '{"ImportPath":"a","Name":"main","Module":{"Path":"m","Version":"v1.10.0"},"Imports":["b"]}'
    two = '{\r\n\t"ImportPath": "b",\r\n\t"Name": "b}\\n{",\r\n\t"Module": {"Path": "m", "Version": "v1.9.0", "Indirect": true}\r\n}\r\n'
    (tmp_path / "x").write_text(one + one.replace('"a"', '"c"') + "\n\n" + two, newline="")
    pkgs = modules.packages(modules.read(spark, str(tmp_path)))
    assert sorted(r["pkg"] for r in pkgs.collect()) == ["a", "b", "c"]
    assert [tuple(r) for r in modules.listed(pkgs).collect()] == [("m", "v1.10.0", True)]
    (tmp_path / "y").write_text('{"ImportPath": ')
    with pytest.raises(Exception):
        modules.read(spark, str(tmp_path)).collect()


def test_coupling_names_and_lines(spark):
    files = spark.createDataFrame([("x/a.go", 'package x\n\nimport "m.org/lib/v2"\nimport w "m.org/lib/v2/sub"\nvar v = lib.A + w.B + other.C\n'), ("b.go", 'package b\nimport (\n\t_ "m.org/lib/v2"\n\t. "n.org/dot"\n\tnm "n.org/dot"\n)\nvar q = nm.Z\n')], "path string, text string")
    pkgs = spark.createDataFrame([("m.org/lib/v2", "m.org/lib/v2", "lib"), ("m.org/lib/v2/sub", "m.org/lib/v2", "sub"), ("n.org/dot", "n.org/dot", "dot"), ("b", "home", "b")], "pkg string, module string, name string")
    assert sorted(map(tuple, imports.coupling(files, pkgs, "home").collect())) == [("m.org/lib/v2", 3, 2, 2), ("n.org/dot", 2, 1, 1)]
    sites = imports.sites_of(files, "n.org/dot", spark.createDataFrame([("home", ".")], "module string, dir string"))
    assert sorted((r["path"], r["line"], r["alias"], r["from_package"]) for r in sites.collect()) == [("b.go", 4, ".", "home"), ("b.go", 5, "nm", "home")]


def test_made_up_executables_take_time_in_proportion():
    """Names are gathered in place: 200,000 long ones would copy tens of GB otherwise."""
    import time

    from heftgraph.plans import executables

    symbols = [(f"mod%2eorg/module/of/some/length/x.Function{k}", 0, k) for k in range(200_000)]
    parts = [(".text", 200_064, True, b""), (".rdata", 8, True, b"")]
    start = time.process_time()
    made = [executables.elf(parts, [(n, 1, a) for n, _, a in symbols]), executables.mach(parts, symbols), executables.pe(parts, symbols), executables.line_table([(n, 1) for n, _, _ in symbols], 0)]
    assert time.process_time() - start < 20
    assert all(symbols[-1][0].encode() in m for m in made)
