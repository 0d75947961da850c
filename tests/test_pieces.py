"""Executables that come in pieces and leave in runs of symbols: files that no row and no task's memory holds."""

import random
import tracemalloc

import duckdb
import pytest
from pyspark.sql import functions as F

from heftgraph import queries, report_queries
from heftgraph.plans import executables as made
from heftgraph.sources import binaries

NAMES = {"elf": (".text", ".gopclntab"), "mach": ("__TEXT __text", "__TEXT __gopclntab"), "pe": (".text", ".rdata")}
TABLE = made.line_table([("a/b.F", 16)], 0x1000)


def pieces(kind, symbols, text=100_000, step=100):
    """The plan's pieces and those of runs of symbols."""
    first = kind == "elf"
    parts = [(NAMES[kind][0], text, True, b""), (NAMES[kind][1], len(TABLE), True, TABLE)]
    names = [n.encode() for n, _ in symbols]
    long = made.SHORT if kind == "pe" else -1
    size = lambda of: sum(len(n) + 1 for n in of if len(n) > long)
    plan = getattr(made, f"{kind}_plan")(parts, len(names), size(names))
    out = list(plan.pieces)
    for at in range(0, len(names), step):
        run = symbols[at : at + step]
        np = made.np
        out += plan.run(names[at : at + step], np.full(len(run), int(first)), np.array([a for _, a in run], np.int64), at, size(names[:at]))
    return parts, out


@pytest.mark.parametrize("kind", ["elf", "mach", "pe"])
def test_pieces_are_the_file(spark, kind):
    symbols = [("s" if k % 3 else f"m/p{k}.Function{k}", 16 * k) for k in range(1500)]
    parts, cut = pieces(kind, symbols)
    raw = getattr(made, kind)(parts, [(n, int(kind == "elf"), a) for n, a in symbols])
    assert made._whole(cut) == raw
    random.Random(1).shuffle(cut)
    rows = binaries.gathered(spark.createDataFrame([(kind, at, bytes(b)) for at, b in cut], "path string, at long, body binary").repartition(3)).cache()
    whole = binaries.parsed(spark.createDataFrame([(kind, raw)], "path string, content binary"))
    of = lambda files: (sorted(map(tuple, binaries.symbols(files).collect())), sorted(map(tuple, binaries.sections(files).collect())), files.select("path", "file_size", "stripped").distinct().collect())
    assert of(rows) == of(whole) and [(n, a) for n, a in sorted((r["name"], r["addr"]) for r in binaries.symbols(rows).collect())] == sorted(symbols)
    assert rows.filter("part = 0").count() == 1 and rows.agg(F.max(F.size("symbols"))).first()[0] <= binaries.RUN
    rows.unpersist()


def test_a_file_of_over_two_gb(spark):
    """A row holds 2 GB at most."""
    symbols = [(f"m/p.F{k}", 5_000_000 * k) for k in range(600)]
    _, cut = pieces("elf", symbols, 3 << 30)
    files = binaries.gathered(spark.createDataFrame([("big", at, bytes(b)) for at, b in cut], "path string, at long, body binary"))
    assert files.select("file_size").first()[0] > 3 << 30
    assert sorted((r["name"], r["addr"]) for r in binaries.symbols(files).collect()) == sorted(symbols)


def test_memory_does_not_grow_with_the_symbols(tmp_path):
    def peak(n):
        _, cut = pieces("elf", [(f"mod.org/some/module.Function{k}", k) for k in range(n)], n + 64, 1 << 14)
        with open(tmp_path / str(n), "w+b") as f:
            for at, b in cut:
                f.seek(at)
                f.write(b)
            f.flush()
            del cut
            tracemalloc.start()
            rows = sum(b.num_rows for b in binaries._rows("x", binaries.View(f.fileno(), 0, f.seek(0, 2))))
            most = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
        assert rows >= n // binaries.RUN
        return most

    peak(1000)
    assert peak(400_000) < 1.5 * peak(100_000)


def test_names_in_any_order_and_shared(monkeypatch):
    raw = b"\0" + b"".join(b"name%d\0" % k for k in range(5000)) + b"l" * 10_000 + b"\0"
    places = [k for k in range(len(raw) + 3)]
    random.Random(2).shuffle(places)
    want = [raw[p : raw.index(b"\0", p)].decode() if p < len(raw) else "" for p in places[:3000]]
    for block, gap in ((8 << 20, 1 << 12), (100, 8)):
        monkeypatch.setattr(binaries, "BLOCK", block)
        monkeypatch.setattr(binaries, "GAP", gap)
        assert binaries._texts(binaries.View.of(raw), made.np.array(places[:3000])) == want
    with pytest.raises(ValueError):
        binaries._texts(binaries.View.of(b"\0open"), made.np.array([1]))


@pytest.mark.parametrize("name", ["stripped_sizes", "binary_symbols", "size_third_party", "size_summary", "binary_sections"])
def test_many_writers_equal_to_sql(spark, monkeypatch, name):
    """Files that several tasks write, a run of symbols or functions each."""
    monkeypatch.setattr(report_queries, "WRITTEN", 2000)
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf).select(columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    files = report_queries._files(spark, sf)
    assert files.agg(F.max(F.greatest(F.size("symbols"), F.size("functions")))).first()[0] <= binaries.RUN
