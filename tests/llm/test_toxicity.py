"""FTRL against a plain loop over dictionaries, missing labels and odd rows."""

import math
import random

import numpy as np

from heftgraph.llm import toxicity
from test_operators import ODD, table


def plain_fit(rows, labels, p):
    """The same updates, one coordinate at a time."""
    z, n, bias = {}, {}, -1

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i == bias:
            return -zi / ((p.beta + math.sqrt(ni)) / p.alpha)
        return 0.0 if abs(zi) <= p.l1 else -(zi - math.copysign(p.l1, zi)) / ((p.beta + math.sqrt(ni)) / p.alpha + p.l2)

    order = np.random.default_rng(1)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)).tolist():
            at = [*map(int, rows[k]), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - labels[k]
            for i in at:
                ni = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / p.alpha * w[i]
                n[i] = ni + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


def made(n=300):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    texts = [" ".join([*r.choices(words, k=30), *(["vileword"] if i % 4 == 0 else [])]) for i in range(n)]
    return texts, [(i, int(i % 4 == 0)) for i in range(n)]


def test_fit_equals_a_plain_loop():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 60, 12)) for _ in range(80)]
    labels = np.array([float(7 in x or 11 in x) for x in rows])
    params = toxicity.Ftrl(l1=0.3, epochs=3)
    model = toxicity.fit(rows, labels, params)
    want, bias = plain_fit(rows, labels, params)
    assert dict(zip(model.places.tolist(), model.weights.tolist())).keys() == want.keys()
    assert np.allclose(model.weights, [want[i] for i in model.places.tolist()], rtol=1e-5) and abs(model.bias - bias) < 1e-5
    assert len(want) < 60  # the L1 term leaves some at zero


def test_without_labels_all_stay(spark):
    texts, labels = made(40)
    docs = table(spark, texts + ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    held = spark.createDataFrame([x for x in labels if toxicity_held(x[0])], "doc_id long, toxic int")
    one_kind = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (3, 0)], "doc_id long, toxic int")
    for few in (none, held, one_kind, odd):
        model = toxicity.train(docs, few)
        assert not model.learnt
        assert toxicity.without_toxic(docs, model).count() == len(texts) + len(ODD)
        assert {x["score"] for x in toxicity.scored(docs, model).collect()} == {0.5}


def toxicity_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_odd_rows(spark):
    """Null and repeated ids, columns called like the operator's own, an empty table, a very long text."""
    texts, labels = made()
    rows = [(i, t, i % 4 == 0) for i, t in enumerate(texts)]
    rows += [(0, texts[0], True), (None, texts[0], True), (None, None, False), (5, "clean " * 300_000, False)]
    docs = spark.createDataFrame([(i, t, 0.5, b, "f") for i, t, b in rows], "doc_id long, text string, score double, y boolean, f string")
    model = toxicity.train(docs, spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int"))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(not x["held_out"] for x in got if x["doc_id"] is None)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    want = sorted((i if i is not None else -1, t or "") for (i, t, bad) in rows if not bad)
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["text"] or "") for x in kept.collect()) == want
    assert toxicity.scored(docs.filter("false"), model).count() == 0
    assert toxicity.without_toxic(docs.filter("false"), model).count() == 0
