import pytest
from pyspark.sql import functions as F

from heftgraph.functions import scalars as fn
from heftgraph.operators.policy import matches


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_versions_in_order(spark):
    order = ["", "1.9", "1.13", "1.21", "1.21rc1", "1.21.0", "1.24", "1.24.0", "1.24.5"]
    got = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(fn.version_key(F.col("v")).asc_nulls_first()).collect()
    assert [r[0] for r in got] == order


def test_symbols_sizes_names(spark):
    assert one(spark, fn.symbol_package, "example%2eorg/x.Fn") == "example.org/x"
    assert one(spark, fn.symbol_package, "go:itab.x") == fn.GENERATED
    assert one(spark, fn.is_aux_symbol, "a/b.f.arginfo1") is True
    assert one(spark, fn.parse_bytes, "25MB") == 25_000_000
    assert one(spark, fn.parse_bytes, " .5 kb ") == 500 and one(spark, fn.parse_bytes, None) is None
    for bad in ("nope", "", "-1 MB", "5"):  # an error, not null
        with pytest.raises(Exception, match="not a size"):
            one(spark, fn.parse_bytes, bad)
    assert one(spark, fn.symbol_package, "a%/b%2ec.F") == "a%/b.c"
    assert one(spark, lambda x: fn.humanize_bytes(x.cast("long")), "1234567") == "1.2 MB"
    assert one(spark, fn.package_alias, "example.org/cli/v2") == "cli"


def test_patterns(spark):
    m = lambda p, x: one(spark, lambda c: matches(c, [p]), x)
    assert m("github.com/a/...", "github.com/a") and m("github.com/a/...", "github.com/a/b") and not m("github.com/a/...", "github.com/ab")
    assert m("github.com/a...", "github.com/ab/c") and m("golang.org/x/*", "golang.org/x/text") and not m("golang.org/x/*", "golang.org/x/text/y")
    assert not m(" ", "x") and not m("[a", "[b")
