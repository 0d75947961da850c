import duckdb
import pytest
from pyspark.sql import functions as F

from heftgraph import queries, source_queries  # noqa: F401
from heftgraph.operators import render
from heftgraph.sources import imports, modules, platforms

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["listed_modules", "listed_imports", "import_sites", "import_sites_constants", "release_cells", "joined_modules", "report_labels"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("end", ["\n", ""])
def test_listing_files(spark, tmp_path, end):
    one = '{\n\t"ImportPath": "a/cmd",\n\t"Name": "main",\n\t"Module": {\n\t\t"Path": "a",\n\t\t"Main": true\n\t},\n\t"Imports": [\n\t\t"b",\n\t\t"c"\n\t]\n}\n'
    (tmp_path / "l.json").write_text(one + '{\n\t"ImportPath": "b",\n\t"Name": "b",\n\t"Module": {\n\t\t"Path": "b",\n\t\t"Version": "v1"\n\t}\n}' + end)
    listing = modules.read(spark, str(tmp_path))
    pkgs = modules.packages(listing)
    assert modules.target(pkgs) == "a/cmd" and [r.pkg for r in modules.roots(pkgs).collect()] == ["a/cmd"]
    assert [tuple(r) for r in modules.imports(listing).collect()] == [("a/cmd", "b")]
    assert [tuple(r) for r in modules.listed(pkgs).collect()] == [("b", "v1", True)]
    with pytest.raises(ValueError):
        modules.roots(pkgs.filter("not is_main"))


def test_source_trees(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "x/a.go").write_text('package x\nimport "m.org/lib"\nimport _ "m.org/lib/side"\nvar v = lib.A + lib.B + lib.A\n')
    (tmp_path / "x/a_test.go").write_text('package x\nimport "m.org/lib"\n')
    (tmp_path / "vendor/v.go").write_text('package v\nimport "m.org/lib"\n')
    got = imports.sites_of(imports.read(spark, str(tmp_path)), "m.org/lib").orderBy("import").collect()
    assert [tuple(r) for r in got] == [("x/a.go", 2, "m.org/lib", "lib", ["A", "B"]), ("x/a.go", 3, "m.org/lib/side", "_", [])]


_SOURCE = """package x

// import "m.org/lib"
/*
import "m.org/lib"
*/
import "m.org/lib"
import r `m.org/raw`

const a = "// " + lib.A + "/*"
const b, c = '"', '\\''
var d = `
import "m.org/none"
lib.Raw \\` + lib.B /* lib.Gone
lib.Gone */ + "\\" lib.Quoted \\\\"
func f(o ...lib.Option) []r.T { return x.lib.Field + lib.
	C("http://lib.Host") }
"""


def test_comments_and_constants(spark):
    files = spark.createDataFrame([("x.go", _SOURCE), ("crlf.go", _SOURCE.replace("\n", "\r\n")), ("empty.go", ""), ("null.go", None), ("open.go", 'package x\nimport "m.org/lib"\nvar a = `lib.A')], "path string, text string")
    got = [tuple(r) for r in imports.import_sites(files).orderBy("path", "line").collect()]
    want = [(7, "m.org/lib", "lib", ["A", "B", "C", "Option"]), (8, "m.org/raw", "r", ["T"])]
    assert got == [("crlf.go", *w) for w in want] + [("open.go", 2, "m.org/lib", "lib", [])] + [("x.go", *w) for w in want]
    packages = spark.createDataFrame([("m.org/lib", "m.org", "lib"), ("m.org/raw", "m.org", "raw")], "pkg string, module string, name string")
    assert [tuple(r) for r in imports.coupling(files, packages, "main").collect()] == [("m.org", 5, 1, 5)]


def test_long_constants(spark):
    text = 'package x\nimport "m.org/lib"\nvar a = "' + "\\\\x00\\\\\"" * 200_000 + '" + lib.A /*' + "*\n" * 200_000 + "*/ + lib.B + `" + "\"'" * 200_000 + "` + lib.C\n"
    got = imports.import_sites(spark.createDataFrame([("x.go", text)], "path string, text string")).collect()
    assert [tuple(r) for r in got] == [("x.go", 2, "m.org/lib", "lib", ["A", "B", "C"])]


def test_platforms_and_rendering(spark):
    assert platforms.parse("linux/arm64+a, b") == ("linux", "arm64", ["a", "b"])
    with pytest.raises(ValueError):
        platforms.parse("linux")
    df = spark.createDataFrame([("b|c", 2), ("a", 1), ("d", None)], "m string, n int")
    assert render.to_markdown(df, ["m"], 2) == "| m | n |\n|-|-|\n| a | 1 |\n| b\\|c | 2 |\n\nMore rows are not shown."
    assert render.to_text(df, [F.desc("m")]).splitlines() == ["M    N", "d", "b|c  2", "a    1"]
    assert '"m": "a"' in render.to_json(df, ["m"], 1)
