"""Importance resampling against features, weights and ranks in plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from heftgraph.llm import resampling

NAMES = "doc_id long, text string, n_features string, rank string, part int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "r", 1, 2.0) for i, t in rows], NAMES)


def features(text, buckets):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(f) % buckets for f in words + [b" ".join(p) for p in zip(words, words[1:])]], len(words)


def brute(rows, target, percent=25, buckets=10_000, seed=7, least=20):
    own = [features(t, buckets) for _, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for f, _ in own:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x, buckets)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for (i, _), (f, n) in zip(rows, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], rank.get(id(r), 0)) for r in out)


def rows_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in df.collect())


def texts(n, seed):
    r = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "d3lta", "épée", "日本", "x" * 40, "a-b", "e", "\x85", "stop.", "é" * 30]
    return [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(n)]


def test_against_brute_force(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(400, 1))]
    rows += [(i, rows[9][1]) for i in range(5000, 5100)] + [(12, rows[4][1])] * 3 + [(None, t) for t in texts(20, 2)] + [(9001, None), (9002, ""), (9003, "many Words " * 50_000), (9004, "w" * 300_000)]
    target = texts(30, 3) + [None, "Alpha beta " * 40]
    got = resampling.resample(frame(spark, rows).repartition(7), spark.createDataFrame([(t, 1) for t in target], "text string, rank int"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == brute(rows, target)


@pytest.mark.parametrize("size", [1, 7, 50])
def test_ranges_and_levels_of_merges(spark, monkeypatch, size):
    """Small ranges, chunks and fan-ins: scores of many rows are cut by doc_id, runs are merged level by level."""
    monkeypatch.setattr(resampling, "RANGE", size)
    monkeypatch.setattr(resampling, "CHUNK", 3)
    monkeypatch.setattr(resampling, "FANIN", 2)
    rows = [(i, t) for i, t in enumerate(texts(150, 5))] + [(7, "one two " * 15)] * 30 + [(None, "one two " * 15)] * 20
    for percent in (1, 50, 100):
        got = resampling.resample(frame(spark, rows).repartition(6), spark.createDataFrame([("one two three",)], "text string"), percent=percent, buckets=50, least_words=5)
        assert rows_of(got) == brute(rows, ["one two three"], percent, 50, 7, 5)


def test_odd_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(frame(spark, []), target).count() == 0
    few = [(1, "too short"), (2, None)]
    assert rows_of(resampling.resample(frame(spark, few), target)) == brute(few, ["a b"])
    some = [(i, t) for i, t in enumerate(texts(40, 8))]
    assert rows_of(resampling.resample(frame(spark, some), target.filter("false"))) == brute(some, [])


def test_tournament():
    r = random.Random(3)
    runs = [sorted((r.randint(0, 50), 0, r.randint(0, 9), 0, 0) for _ in range(r.randint(0, 200))) for _ in range(40)]
    chunks = sorted((rows[i][:4], k, np.array(rows[i : i + 8], np.int64).tobytes()) for k, rows in enumerate(runs) for i in range(0, len(rows), 8))
    whole = sorted(x for rows in runs for x in rows)
    assert list(resampling.merged_rows(iter(chunks))) == whole
    for most in (0, 1, 100):
        got = list(resampling.merged_rows(iter(chunks), most))
        assert got[:most] == whole[:most] and sorted(got) == whole
