"""Top k against all scores, with ties, repeated ids and vectors that take no part."""

import math

import numpy as np

from heftgraph.llm import maxscore


def brute(rows, is_query, k):
    """(query_id, rank, vec_id, score) of every query row; rows are (vec_id, vector)."""
    whole = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, j, c in whole if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def answer(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, row long, score string").repartition(parts)
    return sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in maxscore.top_k(df, "vec_id % 50 = 0", 5).collect())


def test_against_all_scores(spark):
    r = np.random.default_rng(0)
    vectors = r.standard_normal((400, 8)).round(3)
    vectors[7] = vectors[50]  # ties
    vectors[60:70] = vectors[60]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (950, [math.nan] * 8), (1000, [1.0, None]), (1050, [math.inf]), (None, [1.0] * 8)]
    assert answer(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)


def test_repeated_ids_short_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [3.0]), (50, []), (7, [])]
    assert answer(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
    assert answer(spark, rows[:1]) == [] and answer(spark, []) == []
    large = [(0, [2.0**30, 1.0]), (1, [2.0**11, 3.0]), (2, [-(2.0**11), 5.0])]
    assert answer(spark, large) == brute(large, lambda i: i % 50 == 0, 5)


def test_many_blocks(spark, monkeypatch):
    """More blocks of queries than are sent to all tasks."""
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 4)
    monkeypatch.setattr(maxscore, "SENT_BLOCKS", 2)
    r = np.random.default_rng(1)
    rows = [(i * 10, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((120, 4)))]
    assert answer(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
