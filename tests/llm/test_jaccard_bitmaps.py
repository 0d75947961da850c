"""Bitmaps of sets rule pairs out before texts are moved, never a link."""

import random

import numpy as np

from heftgraph.llm import jaccard_join
from heftgraph.llm.words import mix


def tokens(first, n):
    return np.sort(mix(np.arange(first, first + n, dtype=np.uint64)))


def test_bitmaps_bound_the_difference():
    r = random.Random(3)
    for _ in range(300):
        common, left, right = r.randint(1, 3000), r.randint(0, 400), r.randint(0, 4000)
        x = np.concatenate([tokens(0, common), tokens(10_000, left)])
        y = np.concatenate([tokens(0, common), tokens(20_000, right)])
        a, b = jaccard_join.bitmap(x), jaccard_join.bitmap(y)
        apart = jaccard_join.differing(a, b)
        assert apart == jaccard_join.differing(b, a) <= left + right
        assert (left + right - apart) % 2 == 0
    assert jaccard_join.differing(jaccard_join.bitmap(tokens(0, 500)), jaccard_join.bitmap(tokens(5000, 500))) > 150


def test_only_likely_pairs_have_their_texts_compared(spark, monkeypatch):
    # every document shares a rare passage of six words with the next; copies with an edit are linked
    texts = []
    for i in range(12):
        shared = " ".join(f"rare{i // 2}x{j}" for j in range(6))
        texts.append(shared + " " + " ".join(f"w{i}y{j}" for j in range(60)))
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moved = []
    plain = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: moved.extend(map(tuple, pairs.select("a", "b").collect())) or plain(pairs, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(docs, 3, 90).collect()}
    assert got == {**{i: i for i in range(12)}, 12: 0}
    assert moved == [(0, 12)]
