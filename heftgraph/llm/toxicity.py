"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presence of word unigrams, bigrams and one-word skip-grams, and of unigrams of word
stems (the first STEMS bytes of longer words, for inflected forms), hashed to 2**BITS places.
FTRL-proximal gives each coordinate its own rate and, by its L1 term, leaves most weights at zero;
only the places and values of the others are sent to the tasks, 2**BITS of them at most.
The model is fitted on a bounded sample of labelled rows (max_rows, by hash of doc_id); scores are
made for all whole texts.

Results for odd input: null, empty and wordless texts get the score of no features; labels that are
null or other than 0 and 1 aren't learnt from; with repeated labels of a doc_id each row is learnt
from; without labels of both kinds nothing can be told apart, so all scores are 0.5 and no document
is rejected; documents with a null doc_id have no label and aren't held out; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import broadcast_if_small, column, slices, texts, utf8
from heftgraph.llm.words import grams, spans_hash, word_spans

BITS = 20
STEMS = (4, 6)
#: Labelled rows that a model is fitted on, at most in the mean; they are collected as feature ids.
MAX_ROWS = 10_000


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every occurrence."""
    starts, ends, doc = word_spans(data, offsets)
    words = spans_hash(data, starts, ends)
    parts = [grams(words, doc, gaps) for gaps in ((0,), (0, 1), (0, 2))]
    for size in STEMS:
        long = ends - starts > size
        parts.append(grams(spans_hash(data, starts[long], starts[long] + size), doc[long], (0,)))
    h, of = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return (h >> np.uint64(64 - BITS)).astype(np.int64), of


def distinct(f: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) without repetitions, ordered by text."""
    key = np.unique((of.astype(np.int64) << BITS) | f)
    return key & ((1 << BITS) - 1), key >> BITS


@dataclass(frozen=True)
class Model:
    """The weights that aren't zero, by feature, and the bias; learnt tells whether there were labels of both kinds."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    learnt: bool

    def scorer(self):
        """A function of (data, offsets, texts) that scores many texts; it holds the weights by feature."""
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.places] = self.weights
        used = dense != 0

        def score(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
            f, of = features(data, offsets)
            keep = used[f]
            f, of = distinct(f[keep], of[keep])
            total = np.bincount(of, weights=dense[f].astype(float), minlength=n) + self.bias
            return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

        return score


def fit(rows: list[np.ndarray], labels: np.ndarray, params: Ftrl = Ftrl()) -> Model:
    """A model of rows of distinct feature ids, labelled 0 or 1."""
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, False)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(1)
    for _ in range(params.epochs):
        for i in order.permutation(len(rows)).tolist():
            at = np.append(rows[i], 1 << BITS)
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= params.l1, 0.0, -(zi - np.sign(zi) * params.l1) / ((params.beta + root) / params.alpha + params.l2))
            w[-1] = -zi[-1] / ((params.beta + root[-1]) / params.alpha)  # no L1 on the bias
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / params.alpha * w
            n[at] = ni + g * g
    root = np.sqrt(n)
    w = np.where(np.abs(z) <= params.l1, 0.0, -(z - np.sign(z) * params.l1) / ((params.beta + root) / params.alpha + params.l2))
    places = np.flatnonzero(w[:-1])
    return Model(places, w[places].astype(np.float32), float(np.float32(-z[-1] / ((params.beta + root[-1]) / params.alpha))), True)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature ids and labels of about max_rows labelled documents outside the held-out fold, ordered by doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    rows = rows.filter(~is_held_out(F.col("doc_id")))
    total = rows.count()
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    few = broadcast_if_small(rows)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f, of = distinct(*features(*utf8(column(part, "text"))))
                at = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "y"), pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32)))], names=["doc_id", "y", "f"])

    got = texts(docs).join(few, "doc_id").mapInArrow(run, "doc_id long, y int, f array<int>").toArrow()
    ids, y = got["doc_id"].to_numpy(), got["y"].to_numpy().astype(float)
    rows_of = []  # views into the collected buffers, never lists
    for chunk in got["f"].chunks:
        at, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        rows_of += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    order = np.lexsort((y, ids))
    return [rows_of[i] for i in order.tolist()], y[order]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, params: Ftrl = Ftrl()) -> Model:
    return fit(*sample(docs, labels, label, max_rows), params)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = sent.value.scorer()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(score(*utf8(column(part, "text")), part.num_rows))], names=["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, in one pass, with all their columns; all of them if nothing was learnt."""
    if not model.learnt:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = sent.value.scorer()
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.set_column(batch.schema.get_field_index("text"), "text", pa.compute.fill_null(column(batch, "text"), ""))
            at = 0
            for part in slices(named, "text"):
                good = score(*utf8(column(part, "text")), part.num_rows) < threshold
                yield batch.slice(at, part.num_rows).filter(pa.array(good))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)
