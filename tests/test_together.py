"""Several builds are walked together: what they share is kept and followed once."""

from heftgraph.operators import build
from heftgraph.operators.build import together


def test_shared_edges_are_walked_once(spark, monkeypatch):
    packages = spark.createDataFrame([(f"p{i}", f"m{i % 3}", i) for i in range(10)] + [("p1", "m9", 7)], "pkg string, module string, size long")
    chain = [(f"p{i}", f"p{i + 1}") for i in range(8)]
    edges = lambda more: spark.createDataFrame(chain + chain[:2] + more, "src string, dst string")
    roots = spark.createDataFrame([("p0",)], "pkg string")
    parts = {"x": (packages, edges([("p3", "only x")]), roots), "y": (packages, edges([("p8", "p9")]), roots), "z": (packages, edges([]).filter("src <> 'p4'"), roots)}
    walked = []
    plain = build.reach_bits
    monkeypatch.setattr(build, "reach_bits", lambda links, *a: walked.append(links.count()) or plain(links, *a))
    size = lambda i: (f"p{i}", "m9", 7) if i == 1 else (f"p{i}", f"m{i % 3}", i)
    want = [("x", *size(i)) for i in range(9)] + [("x", "only x", "", 0)] + [("y", *size(i)) for i in range(10)] + [("z", *size(i)) for i in range(5)]
    assert sorted(map(tuple, together(parts, False).collect())) == sorted(want)
    assert walked == [10]
    # more builds than a word has bits
    monkeypatch.setattr(build, "WORD", 2)
    assert sorted(map(tuple, together(parts, False).collect())) == sorted(want)
    assert len(walked) == 3
