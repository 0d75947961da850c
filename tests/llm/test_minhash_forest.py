"""The LSH forest against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from heftgraph.llm import minhash_forest

NAMES = "doc_id long, text string, n int, sig string, path string, label int, values string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "p", 2, "v", "k") for i, t in rows], NAMES)


def shingled(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k=2, percent=80):
    sets = [(i, shingled(t, k)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, q in sets[:a]:
            if s and q and i is not None and j is not None and 100 * len(s & q) >= percent * len(s | q):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return sorted((i is None, i or 0, len(s), root(i) or 0 if s else i or 0) for i, s in sets)


def rows_of(df):
    out = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in out)


def corpus(seed, n=260, groups=30):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [[r.choice(words) for _ in range(r.randint(1, 120))] for _ in range(n)]
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(10, 150))]
        for _ in range(r.randint(2, 9)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 14))):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(own)
    r.shuffle(out)
    return [(i * 2 + 1, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("region", [64, 2])
def test_against_all_pairs(spark, monkeypatch, region):
    """Also with regions that are cut as deep as values go."""
    monkeypatch.setattr(minhash_forest, "REGION", region)
    rows = corpus(region)
    assert rows_of(minhash_forest.classes(frame(spark, rows).repartition(5))) == brute(rows)


def test_large_groups(spark):
    """A third of all rows are copies, a third near copies of one text, some of them apart."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = corpus(9, 60, 4) + [(10_000 + i, " ".join(base)) for i in range(150)]
    for i in range(150):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 8])):
            own[r.randrange(80)] = f"x{r.randrange(500)}"
        rows.append((20_000 + i, " ".join(own)))
    assert rows_of(minhash_forest.classes(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    long = "many words and more of them " * 60_000
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (5, "A  B\tc d"), (2, None), (2, ""), (3, "one"), (4, "ONE"), (6, " \t\n"), (7, long), (8, long + "end"), (9, "é é é"), (10, "q" * 300_000)]
    assert rows_of(minhash_forest.classes(frame(spark, rows))) == brute(rows)
    assert minhash_forest.classes(frame(spark, []).filter("false")).count() == 0
    assert rows_of(minhash_forest.classes(frame(spark, [(2, None), (None, "x y")]))) == [(False, 2, 0, 2), (True, 0, 1, 0)]
    # one doc_id with two texts links what resembles either
    twice = [(3, "a b c d e"), (3, "v w x y z"), (1, "a b c d e"), (2, "v w x y z")]
    assert {r["component_id"] for r in minhash_forest.classes(frame(spark, twice)).collect()} == {1}


def test_signatures_estimate_similarity():
    """Values agree as often as sets are similar, for sets of any size."""
    r = np.random.default_rng(3)
    for size in (20, 2000, 60_000):
        every = r.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        a, b = every[:size], every[size // 9 : size // 9 + size]  # similarity 0.8
        agree = [int((minhash_forest.signature(a ^ np.uint64(x)) == minhash_forest.signature(b ^ np.uint64(x))).sum()) for x in range(40)]
        assert abs(np.mean(agree) / minhash_forest.VALUES - 0.8) < 0.03 and min(agree) >= minhash_forest.AGREE
    assert len({tuple(o[:4]) for o in minhash_forest._ORDERS.tolist()}) == minhash_forest.TREES and all(len(set(o)) == minhash_forest.DEPTH for o in minhash_forest._ORDERS.tolist())


def test_finer_signatures_estimate_similarity():
    r = np.random.default_rng(8)
    every = r.integers(0, 1 << 63, 6000, dtype=np.uint64)
    for shared, similarity in ((8 / 9, 0.8), (2 / 3, 0.5)):
        off = round(3000 * (1 - shared))
        a, b = every[:3000], every[off : off + 3000]
        agree = [int(minhash_forest.agreeing(*(minhash_forest.fine_signature(s ^ np.uint64(x)).view(np.uint64) for s in (a, b)))) for x in range(20)]
        assert abs(np.mean(agree) / minhash_forest.FINE - (1 + similarity) / 2) < 0.01
        assert (min(agree) >= minhash_forest.FINE_AGREE) == (similarity == 0.8)


def test_large_leaves_send_links_alone(spark, monkeypatch):
    """Many documents of one leaf that are close, but not linked, make no rows of pairs."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[:99] + [f"c{i}"])) for i in range(600)]
    for i in range(30):  # similarity 0.77 to those; two pairs are linked
        own = list(base)
        for at in r.sample(range(1, 99, 2), 6):
            own[at] = f"x{i}y{at}"
        own[99] = f"d{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, rows[600 + i][1] + " end") for i in range(2)]
    seen = []
    verified = minhash_forest.verified
    monkeypatch.setattr(minhash_forest, "REGION", 2)
    monkeypatch.setattr(minhash_forest, "PART", 64)
    monkeypatch.setattr(minhash_forest, "verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    assert rows_of(minhash_forest.classes(frame(spark, rows))) == brute(rows)
    # neighbours of 32 documents in 32 orders, and best ones
    assert sum(seen) <= 2 * 32 * 32 + 2 * len(rows), seen


def test_links_of_blocks(spark):
    """Every class that a link joins is joined, by one link of two blocks, whatever the blocks' sizes; pairs of an earlier order are left to it."""
    rows = [(i, t) for i, t in corpus(17, 60, 25) if len(t.split()) > 4]
    rows += [(9001, rows[0][1]), (9001, rows[1][1] + " end")]
    docs, ids = frame(spark, rows), [(i,) for i, _ in rows]
    label = spark.createDataFrame([(i, i) for i in {i for i, _ in rows}], "node long, label long")
    found = spark.createDataFrame([(bytearray([3, 0, 1]), i) for (i,) in set(ids)], "prefix binary, doc_id long")
    whole = minhash_forest.fine_signatures(spark.createDataFrame(ids, "doc_id long"), docs, 2, True)
    homes = minhash_forest.homes_of(found)
    want = brute(rows)
    for part, shingles in ((256, 1 << 18), (20, 1 << 18), (256, 900)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(minhash_forest, "PART", part)
            m.setattr(minhash_forest, "PART_SHINGLES", shingles)
            blocks = minhash_forest.leaf_blocks(found, label, whole, homes).collect()
            assert len(blocks) > 2 or (part, shingles) == (256, 1 << 18)
            links = minhash_forest.block_links(minhash_forest.leaf_blocks(found, label, whole, homes), 80)
        named = {r["node"]: r["label"] for r in minhash_forest.components(links.selectExpr("a u", "b v")).collect()}
        assert sorted({(i, named.get(i, i)) for i, _ in rows}) == sorted({(i, c) for _, i, _, c in want})
        if len(blocks) < 3:
            assert links.count() == len({i for i, _ in rows}) - len({c for *_, c in want})
    earlier = homes.selectExpr("doc_id", "transform(homes, (h, i) -> if(i = 1, 7L, h)) homes")
    assert minhash_forest.block_links(minhash_forest.leaf_blocks(found, label, whole, earlier), 80).count() == 0
