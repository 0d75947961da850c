"""Whitening against whole-matrix sums in Python's integers and the library's eigen-solver."""

import numpy as np
import pytest

from heftgraph.llm import whitening

NAMES = "vec_id long, embedding array<float>, label int, x string, part int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "n") for i, v in rows], NAMES)


def brute(rows, most=4):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = [[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    values, vectors = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), v in zip(good, x):
        z = (np.array(v) - np.array(s) / n) @ vectors[:, :most] / np.sqrt(values[:most])
        out.append((i, n, sum((n * c - t) ** 2 for c, t in zip(v, s)), z, values[:most] / values.sum()))
    return out


def check(got, want, most=4):
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["deviation_wide"], r["component"], r) for r in got), key=lambda t: t[:4])
    want = sorted(want, key=lambda t: (t[0] is None, t[0] or 0, t[2]))
    assert len(got) == most * len(want)
    rows = [[t[4] for t in got[i : i + most]] for i in range(0, len(got), most)]
    a, b = np.array([[r["whitened"] for r in own] for own in rows]), np.array([w[3] for w in want])
    assert np.allclose(a * np.sign((a * b).sum(axis=0)), b, atol=1e-9)
    for own, (i, n, deviation, _, explained) in zip(rows, want):
        assert [r["component"] for r in own] == list(range(1, most + 1))
        assert all(r["vec_id"] == i and r["n"] == n and r["deviation"] == deviation == r["deviation_wide"] and r["identity_error"] < 1e-9 for r in own)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9)


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((300, 9)) * np.arange(1, 10)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(200)]  # copies count once
    rows += [(7, base[3].tolist()), (None, base[5].tolist()), (2000, None), (2001, [1.0, None] + [0.0] * 7), (2002, [float("nan")] * 9), (2003, [float("inf")] + [0.0] * 8), (2004, [-0.0] * 9), (2005, [0.5, -0.25])]
    check(whitening.whiten(frame(spark, rows).repartition(5)).collect(), brute(rows))


def test_merges_of_many_parts(spark):
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((400, 5)))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        check(whitening.whiten(frame(spark, rows), 3).collect(), brute(rows, 3), 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    line = whitening.whiten(frame(spark, [(i, [float(i), float(i), 0.0]) for i in range(9)])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True, 3: True}
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-9 and r["identity_error"] < 1e-9 for r in line)
    far = {r["vec_id"]: r for r in whitening.whiten(frame(spark, [(i, [1e12 * i, 1.0, 0.0]) for i in range(5)])).collect()}
    assert far[0]["deviation"] is None and int(far[0]["deviation_wide"]) == (sum(int(np.floor(256 * np.float64(np.float32(1e12 * i)))) for i in range(5))) ** 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    r = np.random.default_rng(n)
    q, _ = np.linalg.qr(r.standard_normal((n, n)))
    for values in (r.standard_normal(n) * 10, np.ones(n), np.arange(n) // 3 * 1.0, 10.0 ** -np.arange(n), np.zeros(n)):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        found, vectors = whitening.symmetric_qr(a)
        assert np.allclose(found, np.sort(values)[::-1], atol=1e-12 * max(1, np.abs(values).max()))
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
        assert np.allclose(a @ vectors.T, vectors.T * found, atol=1e-12 * max(1, np.abs(values).max()))


def test_parallel_update_is_the_stepwise_one():
    x = np.random.default_rng(2).integers(-500, 500, (101, 6))
    whole, left, right, none = (whitening.Moments(6) for _ in range(4))
    for k, row in enumerate(x):
        whole.add(row.astype(float))
        (left if k < 37 else right).add(row.astype(float))
    none.merge(left)
    none.merge(right)
    assert none.n == 101 and np.allclose(none.mean, x.mean(axis=0)) and np.allclose(none.covariance(), np.cov(x.T, bias=True)) and np.allclose(whole.covariance(), none.covariance())
