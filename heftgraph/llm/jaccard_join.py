"""N-gram Jaccard join with token-combination prefixes, and the classes its links make.

Tokens are word shingles. Documents of equal sets are one class from the start. Every set is put in
one order of all tokens, rare before frequent: first those that aren't seen to repeat, by the summed
log counts of their words (a shingle with a rare word is rare), then the others by their own counts; two sets that reach the threshold then share k tokens
among their first n - ceil(t n) + k. Rare tokens of that prefix are indexed singly, those of the
frequent class in combinations of k = 2. Sets over LONG tokens, for which combinations would be
many, index single frequent tokens; around LONG both are done, so that no pair within the length
filter falls between. The order never decides what is found, only how fast.

Links are made without all pairs of a bucket: first each document is verified against a central
document of its buckets, the one it shares most keys with; in further turns, documents outside a
bucket's largest class are verified against another member of it; then, for what is not connected
yet, every pair of a bucket that lies in different classes is verified, minority classes against
the rest. A bucket that is large even then is that of a token that counts as rare and isn't: its
documents are indexed anew, by that token together with every other one of their prefixes. Since
linked sets share two prefix tokens, they meet there. So all classes are exact.

Before texts are moved, pairs are held against each other by bitmaps of their sets: each token flips the bit
of its hash, so two bitmaps differ in no more bits than the sets have tokens that aren't common. Pairs that
differ in too many can't reach the threshold; no link is lost.

Results for odd input: null, empty and wordless texts have no shingles and stay alone; repeated
rows of a document appear each; a null doc_id stays alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import broadcast_if_small, column, forget, release, settle, slices, texts, utf8
from heftgraph.llm.links import compared, components
from heftgraph.llm.words import hash_words, mix, shingle_sets, shingles, weighted_sets

#: Repetitions from which a token belongs to the frequent class.
FREQUENT = 256
#: Sets of more tokens than this index frequent tokens singly.
LONG = 256
#: Tokens whose counts are sent to all tasks, the most frequent ones: 16 bytes each. The others count as rare.
KNOWN = 1 << 18
#: Turns in which documents meet single members of a class before all open pairs are verified.
STARS = 3
#: Documents of one bucket in different classes from which its single token is indexed in combinations.
SPLIT = 256
#: Shingles that a task counts before it passes on the repeated ones.
WINDOW = 2_000_000


def _sets(batches, k: int):
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, shingle_sets(*utf8(column(part, "text")), k)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for every remainder of hashes, set if an odd number of tokens has it; as many bits as tokens or up to twice as many, 64 at least."""
    size = 1 << max(6, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).view(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the larger one folded to the size of the other: at most the tokens that only one of the sets has."""
    if len(x) < len(y):
        x, y = y, x
    a = int.from_bytes(x, "little")
    for size in (8 * len(y) << j for j in reversed(range((len(x) // len(y)).bit_length() - 1))):
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), sig (128-bit digest of the set), bits (its bitmap)."""

    def run(batches):
        for part, sets in _sets(batches, k):
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())], names=["doc_id", "n", "sig", "bits"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, sig binary, bits binary")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that the sizes and bitmaps of sets(doc_id, n, bits) don't rule out, all links among them."""

    def run(batches):
        for batch in batches:
            n = column(batch, "na").to_numpy() + column(batch, "nb").to_numpy()
            apart = np.array([differing(x, y) for x, y in zip(column(batch, "left").to_pylist(), column(batch, "right").to_pylist(), strict=True)], np.int64)
            good = (100 + percent) * apart <= (100 - percent) * n
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("right"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(near).mapInArrow(run, "a long, b long").distinct()


def repeated(docs: DataFrame, k: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Shingles and words that repeat within tasks' windows over all documents, ascending, with their counts; at most KNOWN of each."""

    def run(batches):
        held: tuple[list, list] = ([], [])
        n = 0

        def flush():
            for kind, least in ((0, 2), (1, 4)):
                tokens, count = np.unique(np.concatenate(held[kind]), return_counts=True)
                often = count >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), kind, np.int32)), pa.array(tokens[often].view(np.int64)), pa.array(count[often])], names=["kind", "token", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                words, doc = hash_words(*utf8(column(part, "text")))
                h, of = shingles(words, doc, part.num_rows, k)
                bounds = np.searchsorted(of, np.arange(part.num_rows + 1))
                held[0].extend(np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
                held[1].append(words)
                n += len(words)
                if n >= WINDOW:
                    yield from flush()
                    held, n = ([], []), 0
        if held[1]:
            yield from flush()

    total = settle(docs.mapInArrow(run, "kind int, token long, c long").groupBy("kind", "token").agg(F.sum("c").alias("c")).filter("c >= 8"), "counts")
    out = []
    for kind in (0, 1):
        got = total.filter(F.col("kind") == kind).orderBy(F.desc("c"), "token").limit(KNOWN).toPandas()
        tokens = got["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        out.append((tokens[order], got["c"].to_numpy(np.int64)[order]))
    return out[0], out[1]


def _pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xC2B2AE3D27D4EB4F))


def _ordered(tokens: np.ndarray, weight: np.ndarray, known: np.ndarray, counts: np.ndarray, need: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix in the one order of all tokens, as places in tokens, and the counts of all."""
    freq = np.zeros(len(tokens), np.int64)
    if len(known):
        p = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        freq = np.where(known[p] == tokens, counts[p], 0)
    return np.lexsort((tokens, weight, freq))[: len(tokens) - need + k], freq


def split_keys(tokens: np.ndarray, weight: np.ndarray, known: np.ndarray, counts: np.ndarray, percent: int, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each large token of a set's prefix with every other token of it, and what each lets share at most."""
    n = len(tokens)
    need = -(-percent * n // 100)
    if need < 2:  # such a set is linked with equal ones only
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, _ = _ordered(tokens, weight, known, counts, need, 2)
    own = tokens[first]
    i, j = np.nonzero(np.isin(own, large)[:, None] & (np.arange(len(own))[:, None] != np.arange(len(own))))
    lo, hi = np.minimum(i, j), np.maximum(i, j)
    once = np.unique(lo * len(own) + hi)
    lo, hi = once // len(own), once % len(own)
    return _pair_key(own[lo], own[hi]) ^ np.uint64(0x5851F42D4C957F2D), n + 1 - hi


def prefix_keys(tokens: np.ndarray, weight: np.ndarray, known: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set, and for each the most tokens it can share with a set whose first common tokens are the key's.

    weight is an estimate of each token's frequency.
    """
    n = len(tokens)
    need = -(-percent * n // 100)
    k = 2 if need >= 2 else 1
    first, freq = _ordered(tokens, weight, known, counts, need, k)
    rare = np.flatnonzero(freq[first] < FREQUENT)
    often = np.flatnonzero(freq[first] >= FREQUENT)
    single = rare
    if k == 1 or n >= LONG * percent // 100:
        single = np.concatenate([rare, often])
    keys, rest = [tokens[first][single]], [n - single]
    if k == 2 and n <= LONG and len(often) > 1:
        i, j = np.triu_indices(len(often), 1)
        own = tokens[first][often]
        keys.append(_pair_key(own[i], own[j]))
        rest.append(n + 1 - often[j])
    return np.concatenate(keys), np.concatenate(rest)


def index(docs: DataFrame, k: int, percent: int, tokens: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, doc_id, n, rest of every document's prefix keys, given counts of tokens and words.

    With a column large (an array of keys) of docs, the keys are those of split_keys() for them.
    """
    split = "large" in docs.columns
    sent = docs.sparkSession.sparkContext.broadcast((tokens, (words[0], np.rint(16 * np.log2(words[1])).astype(np.int64))))

    def run(batches):
        known, (word, weight) = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = weighted_sets(*utf8(column(part, "text")), k, word, weight)
                if split:
                    large = [np.array(x, np.int64).view(np.uint64) for x in column(part, "large").to_pylist()]
                    keys = [split_keys(s, w, *known, percent, x) if len(s) else (s, w) for (s, w), x in zip(sets, large, strict=True)]
                else:
                    keys = [prefix_keys(s, w, *known, percent) if len(s) else (s, w) for s, w in sets]
                size = [len(x) for x, _ in keys]
                ids = column(part, "doc_id").take(pa.array(np.repeat(np.arange(len(size)), size)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in keys]).view(np.int64)), ids, pa.array(np.repeat([len(s) for s, _ in sets], size), pa.int32()), pa.array(np.concatenate([x for _, x in keys]), pa.int32())], names=["key", "doc_id", "n", "rest"])

    return docs.mapInArrow(run, "key long, doc_id long, n int, rest int")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets reach the threshold, counted exactly over the whole texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                left = shingle_sets(*utf8(column(part, "text_a")), k)
                right = shingle_sets(*utf8(column(part, "text_b")), k)
                good = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return compared(pairs, docs, run, "a long, b long", "links")


def _labelled(buckets: DataFrame, label: DataFrame) -> DataFrame:
    named = label.withColumnRenamed("node", "doc_id")
    return buckets.join(named, "doc_id", "left").select("key", "doc_id", "n", "rest", F.coalesce("label", "doc_id").alias("label"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """key, top (its most frequent class) of the buckets with more than one class."""
    own = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
    return own.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("top")).filter("labels > 1").select("key", "top")


def _open_rows(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """key, doc_id, n, rest, label, top of the buckets whose documents lie in different classes."""
    labelled = settle(_labelled(buckets, label), "labelled")
    return settle(labelled.join(settle(_mixed(labelled), "mixed"), "key").select("key", "doc_id", "n", "rest", "label", "top"), "other")


def index_tokens(docs: DataFrame, k: int) -> DataFrame:
    """key: those of the keys large (an array) of docs that are tokens of the document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*utf8(column(part, "text")), k)
                large = [np.array(x, np.int64).view(np.uint64) for x in column(part, "large").to_pylist()]
                found = [x[np.isin(x, s)] for s, x in zip(sets, large, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64))], names=["key"])

    return docs.mapInArrow(run, "key long").distinct()


def _merged(label: DataFrame | None, found: DataFrame) -> DataFrame:
    """The classes of label after the links found(a, b); a class enters as the star of its label."""
    edges = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if label is None:
        return components(edges)
    if not found.limit(1).count():
        return label
    return components(label.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(edges))


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) for every row of docs."""
    spark = docs.sparkSession
    own = settle(signatures(docs, k), "signatures")
    reps = settle(own.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")), "reps")
    few = broadcast_if_small(reps.select(F.col("rep").alias("doc_id")))
    single = texts(docs).join(few, "doc_id", "left_semi")
    sets = settle(own.filter("n > 0").join(few, "doc_id", "left_semi").select("doc_id", "n", "bits"), "sets")
    counts = repeated(single, k)
    keys = settle(index(single, k, percent, *counts), "keys")
    release(spark)
    heavy = settle(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "heavy")
    release(spark)
    met = settle(keys.join(heavy, "key").select("key", "doc_id", "n", "rest"), "met")
    forget(keys)
    release(spark)
    # a document with few keys of its own shares most, so it's the likeliest centre of its buckets
    degree = settle(met.groupBy("doc_id").agg(F.count("*").alias("degree")), "degrees")
    buckets = settle(met.join(degree, "doc_id"), "buckets")
    forget(heavy, met, degree)
    release(spark)
    label, tried = None, None
    for turn in range(STARS):
        if label is None:
            leaders = buckets.groupBy("key").agg(F.max_by("doc_id", F.struct("degree", -F.col("doc_id"))).alias("leader"))
            open_rows = buckets
        else:
            labelled = settle(_labelled(buckets, label), "labelled")
            mixed = settle(_mixed(labelled), "mixed")
            if not mixed.limit(1).count():
                break
            inside = settle(labelled.join(mixed, "key"), "inside")
            leaders = inside.filter("label = top").groupBy("key").agg(F.max_by("doc_id", F.xxhash64("doc_id", F.lit(turn))).alias("leader"))
            open_rows = inside.filter("label <> top")
        leaders = settle(leaders, "leaders")
        shared = open_rows.join(leaders, "key").filter("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("c"))
        stars = shared.groupBy("doc_id").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
        stars = stars.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
        stars = settle(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "stars")
        near = settle(possible(stars, sets, percent), "near")
        found = verified(near, docs, k, percent)
        forget(near)
        tried = stars if tried is None else tried.unionByName(stars)
        label = _merged(label, found)
        release(spark)
    # what shares a bucket but not a class
    other = _open_rows(buckets, label)
    large = settle(other.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > SPLIT).select("key"), "large")
    if not large.isEmpty():
        large_rows = other.join(broadcast_if_small(large), "key", "left_semi")
        # the large tokens of one document's prefix
        again = settle(large_rows.groupBy("doc_id").agg(F.collect_set("key").alias("large")), "again")
        finer = settle(index(single.join(again, "doc_id"), k, percent, *counts), "finer")
        # keys that are combinations already have no finer ones; they stay
        tokens = settle(index_tokens(single.join(again, "doc_id"), k), "tokens")
        rest = other.join(broadcast_if_small(tokens), "key", "left_anti").select("key", "doc_id", "n", "rest")
        other = _open_rows(rest.unionByName(finer.select(rest.columns)), label)
    x = other.filter("label <> top").select("key", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx"), F.col("label").alias("lx"))
    y = other.select("key", F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("ry"), F.col("label").alias("ly"), "top")
    # at the row of a pair's first common tokens rest bounds what it shares, so a link passes there
    most = F.least("rx", "ry")
    close = (100 * most >= percent * (F.col("nx") + F.col("ny") - most)) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("top")) | (F.col("x") < F.col("y")))
    pairs = x.join(y, "key").filter(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = settle(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    near = settle(possible(pairs, sets, percent), "near")
    more = verified(near, docs, k, percent)
    final = _merged(label, more).withColumnRenamed("node", "rep")
    named = settle(reps.join(final, "rep", "left").select("sig", F.coalesce("label", "rep").alias("label")), "named")
    forget(buckets, other, pairs, tried, reps, near, sets)
    release(spark)
    joined = own.join(named, "sig", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull() | F.col("label").isNull()
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))
