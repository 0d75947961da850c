"""The merge index against plain grouping: levels, filters, collisions, odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heftgraph.llm import exact_dedup
from test_operators import mixed, table


def check(rows, docs, largest):
    """rows(doc_id, keep_id, group_size, kept, text_sha256) against grouping docs [(id, text)] by text."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        kept = [False] * len(ids)
        kept[ids.index(keep)] = True
        want += [(i, keep, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(ids, kept)]
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("largest", [True, False])
def test_against_grouping(spark, largest):
    texts = mixed() * 3
    docs = table(spark, texts).repartition(12)
    stored = exact_dedup.runs(exact_dedup.texts(docs), largest)
    assert stored.filter("filter is not null").count() >= 12  # two levels of compaction at least
    check(exact_dedup.dedup(docs, largest).collect(), list(enumerate(texts)), largest)


@pytest.mark.parametrize("largest", [True, False])
def test_null_and_repeated_ids(spark, largest):
    rows = [(None, "a"), (None, "a"), (None, "b"), (5, "a"), (5, "a"), (5, "c"), (None, None), (7, ""), (-(2**63), "d"), (2**63 - 1, "d"), (None, "d"), (3, "e")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").repartition(5)
    check(exact_dedup.dedup(df, largest).collect(), rows, largest)
    check(exact_dedup.dedup(df.filter("doc_id is null and text is not null and text <> 'd'"), largest).collect(), [r for r in rows if r[0] is None and r[1] and r[1] != "d"], largest)
    assert exact_dedup.dedup(df.filter("false"), largest).count() == 0


def test_filters_decide_where_to_look():
    """A run whose filter excludes a digest isn't looked up, even where it has it; a filter keeps what it holds."""
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(200)]
    hashes = exact_dedup._hashes(digests)
    assert exact_dedup.may_hold(exact_dedup.bloom(hashes[:100]), hashes[:100]).all()
    assert exact_dedup.may_hold(exact_dedup.bloom(hashes[:100]), hashes[100:]).sum() < 10
    entries = pa.table({"at": [0] * 4, "slice": [0] * 4, "level_run": [1, 1, 2, 2], "run": ["x", "x", "y", "y"], "variant": pa.array([0] * 4, pa.int32()), "digest": [digests[0], digests[1], digests[1], digests[2]], "best": [4, 9, 8, 1], "n": [1, 2, 3, 4]})
    honest = pa.table({"level_run": [1, 2], "filter": [exact_dedup.bloom(hashes[:2]), exact_dedup.bloom(hashes[1:3])]})
    out = exact_dedup.merge_runs(entries, honest, True).to_pylist()
    assert {(r["best"], r["n"]) for r in out if r["kind"] == 0} == {(4, 1), (9, 5), (1, 4)}
    assert [(r["best"], r["won"]) for r in out if r["kind"] == 1] == [(8, 9)]
    blind = pa.table({"level_run": [1, 2], "filter": [bytes(8), bytes(8)]})
    assert sum(r["kind"] == 0 for r in exact_dedup.merge_runs(entries, blind, True).to_pylist()) == 4


def test_colliding_digests(spark):
    """Rows whose digests collide are grouped by their texts."""
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "doc_id long, text string")
    digest = df.selectExpr("unhex(sha2(text, 256)) as digest").distinct()
    check(exact_dedup.by_text(df, digest, True).collect(), [(1, "a"), (2, "a"), (3, "b"), (None, "b")], True)
    lost = df.filter("doc_id = 2").selectExpr("unhex(sha2('a', 256)) as digest", "2L as best", "1L as won")
    assert exact_dedup.differing(lost, df).count() == 0
