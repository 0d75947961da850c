"""Near-duplicate classes by an LSH forest over MinHash signatures.

A document's set holds its word shingles; documents of equal sets are one class from the start. The
signature is VALUES minima, and each of TREES orders lists DEPTH of them, the first four of its own.

Neighbours: for each order, all paths are sorted, and documents that stand beside each other with a
common prefix of SHALLOW values or more are candidates; first each document's likeliest neighbour is
verified, then the one of another class that agrees most, then all others. Regions: documents that share
the prefix are candidates too. A region of more than REGION documents is cut by further values, as deep
as it needs, down to DEPTH; regions of one class need no pairs. At the leaves all documents of different
classes are candidates, however many there are, and are held against each other by finer signatures.
Large leaves, those that are still over REGION documents at DEPTH, are dealt out in blocks that carry whole
sets: pairs of blocks are verified where they meet, and only links leave, one for two classes that a pair of
blocks joins. So candidates, which grow with the square of a leaf, never become rows. In the other leaves
those close to the threshold do, at most REGION a document and order; of those, again, each document's best
one is verified first.

Neighbours whose signatures agree in fewer than AGREE values are left out, and so are pairs of finer
signatures that agree in fewer than FINE_AGREE (a pair of similarity 0.8 does so once in 10^7 times); the
others are verified over their whole texts, exactly. A pair of similarity 0.8 in small regions is missed
with probability (1 - 0.8^3)^32 = 1e-10; in regions that are cut to the last value, with (1 - 0.8^8)^32 =
0.003, if no other document links the two.

Results for odd input: null, empty and wordless texts have no shingles and stay alone; repeated rows of
a document appear each; rows of one doc_id with different texts are one document to links; a null doc_id
stays alone (component_id null, kept); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import bounded_batches, broadcast_if_small, column, forget, release, settle, slices, small, texts, utf8
from heftgraph.llm.jaccard_join import verified
from heftgraph.llm.links import components
from heftgraph.llm.words import mix, shingle_sets

VALUES = 128
TREES = 32
DEPTH = 8
#: Values that candidates share at least in some order.
SHALLOW = 3
#: Documents of a region from which on it is cut by a further value.
REGION = 64
#: Of VALUES values, those that agree for a pair of similarity 0.8, less 5.6 standard deviations.
AGREE = 76
#: Bits of a finer signature, one a value, and those that agree for a pair of similarity 0.8 (nine tenths), less 5 standard deviations.
FINE, FINE_AGREE = 2048, 1775
#: Turns in which only the best candidates in leaves are verified, before all are.
BEST_TURNS = 2
#: Documents of a block of a leaf: 256 finer signatures are 64 kB. Shingles of a block that carries whole sets: 2 MB.
PART, PART_SHINGLES = 256, 1 << 18
#: Shingles whose hashes under all functions are held at once: 4 MB.
BLOCK = 4096

_rng = np.random.default_rng(20240613)
_MULTIPLY = _rng.integers(1, 1 << 63, VALUES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES + FINE, dtype=np.uint64)
#: The first four values of an order are in no other order's first four.
_ORDERS = np.array([[(4 * t + j) % VALUES if j < 4 else (4 * t + 4 * j * j + j) % VALUES for j in range(DEPTH)] for t in range(TREES)])


def _minima(tokens: np.ndarray, first: int, n: int) -> np.ndarray:
    """The minimum of each of n hash functions over a set, mixed."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = BLOCK * VALUES // n
    for i in range(0, len(tokens), step):
        np.minimum(least, ((tokens[i : i + step, None] ^ _ADD[first : first + n]) * _MULTIPLY[first : first + n]).min(axis=0), out=least)
    return mix(least)


def signature(tokens: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each hash function over a set."""
    return _minima(tokens, 0, VALUES).astype(np.uint16)


def fine_signature(tokens: np.ndarray) -> np.ndarray:
    """One bit of the minimum of each further hash function over a set, packed."""
    return np.packbits((_minima(tokens, VALUES, FINE) & np.uint64(1)).astype(np.uint8))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), sig (128-bit digest of the set), values (the signature; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*utf8(column(part, "text")), k)
                sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                values = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "n", "sig", "values"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, sig binary, values binary")


def _fixed(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return utf8(column(batch, name))[0].reshape(-1, width)


def paths(signed: DataFrame) -> DataFrame:
    """path (number of the order, then its values, high bytes first), doc_id: a row an order for each of signed(doc_id, values)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                values = _rows_of(column(part, "values"), np.uint16)
                each = np.empty((len(values), TREES, 1 + 2 * DEPTH), np.uint8)
                each[:, :, 0] = np.arange(TREES)
                each[:, :, 1:] = np.ascontiguousarray(values[:, _ORDERS].astype(">u2")).view(np.uint8)
                flat = pa.Array.from_buffers(pa.binary(1 + 2 * DEPTH), len(values) * TREES, [None, pa.py_buffer(each.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([flat, column(part, "doc_id").take(pa.array(np.repeat(np.arange(len(values)), TREES)))], names=["path", "doc_id"])

    return signed.select("doc_id", "values").mapInArrow(run, "path binary, doc_id long")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, depth of rows beside each other with a common prefix; the first and last row with their paths."""
    last: tuple | None = None
    names = ["path", "doc_id", "a", "b", "depth"]

    def end(path: np.ndarray, doc: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([path.tobytes()], pa.binary()), pa.array([doc], pa.int64()), none, none, none], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        path, doc = _fixed(batch, "path", 1 + 2 * DEPTH), column(batch, "doc_id").to_numpy()
        if last is None:
            yield end(path[0], doc[0])
        else:
            path, doc = np.concatenate([last[0][None], path]), np.concatenate([[last[1]], doc])
        last = (path[-1].copy(), doc[-1])
        same = path[1:] == path[:-1]
        depth = (np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) - 1) // 2
        ok = (depth >= SHALLOW) & (doc[1:] != doc[:-1])
        a, b = np.minimum(doc[1:], doc[:-1])[ok], np.maximum(doc[1:], doc[:-1])[ok]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.array(depth[ok].astype(np.int64))], names=names)
    if last is not None:
        yield end(*last)


def neighbours(forest: DataFrame) -> DataFrame:
    """a < b, times (orders), depth (longest common prefix) of documents that stand beside each other in an order."""
    schema = "path binary, doc_id long, a long, b long, depth long"
    found = settle(forest.repartitionByRange("path", "doc_id").sortWithinPartitions("path", "doc_id").mapInArrow(_beside, schema), "beside")
    # two rows a partition: where one ends and the next begins
    ends = found.filter("path is not null").select("path", "doc_id").repartition(1).sortWithinPartitions("path", "doc_id").mapInArrow(_beside, schema)
    pairs = found.filter("a is not null").select("a", "b", "depth").unionByName(ends.filter("a is not null").select("a", "b", "depth"))
    out = settle(pairs.groupBy("a", "b").agg(F.count("*").alias("times"), F.max("depth").alias("depth")), "neighbours")
    forget(found)
    return out


def _best(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of pairs(a, b, ...) those that are the best one of a or of b."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), *by).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), *by))
    best = both.groupBy("x").agg(F.max_by("y", F.struct(*by, -F.col("y"))).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values of two signatures agree (the last axis: uint16), or how many bits of two finer ones (uint64)."""
    if left.dtype == np.uint64:
        return FINE - np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)
    return (left == right).sum(axis=-1)


def likely(pairs: DataFrame, signed: DataFrame, least: int = AGREE, kind=np.uint16) -> DataFrame:
    """a, b, agree: the pairs(a, b) whose signatures (values of signed) agree in so many values or more."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                left, right = (_rows_of(column(batch, c), kind) for c in ("left", "right"))
                agree = agreeing(left, right)
                yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(agree.astype(np.int64))], names=["a", "b", "agree"]).filter(pa.array(agree >= least))

    left = signed.select(F.col("doc_id").alias("a"), F.col("values").alias("left"))
    right = signed.select(F.col("doc_id").alias("b"), F.col("values").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, agree long").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _joined(label: DataFrame, found: DataFrame) -> DataFrame:
    """The classes after the links found(a, b); a class enters as the star of its label."""
    if found.isEmpty():
        return label
    out = components(label.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    forget(label)
    return out


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs(a, b) that lie in different classes."""
    few = label.filter("node <> label")
    la, lb = (small(few.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), 16) for c in ("a", "b"))
    joined = pairs.join(la, "a", "left").join(lb, "b", "left")
    return joined.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select(pairs.columns)


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    few = label.filter("node <> label").withColumnRenamed("node", "doc_id")
    return rows.join(small(few, 16), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def leaves(forest: DataFrame, label: DataFrame) -> DataFrame:
    """prefix, doc_id, large (whether it is cut to the last value and has more than REGION documents even so) of all leaves with several classes.

    A region with several classes is cut by further values while it has more than REGION documents.
    """
    rows = _labelled(forest, label)
    done = None
    for depth in range(SHALLOW, DEPTH + 1):
        rows = rows.withColumn("prefix", F.expr(f"substring(path, 1, {1 + 2 * depth})"))
        sizes = settle(rows.groupBy("prefix").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("prefix", "c"), "regions")
        inside = settle(rows.join(small(sizes, 64), "prefix").select("path", "prefix", "doc_id", "label", "c"), "inside")
        here = inside.filter(F.lit(depth == DEPTH) | (F.col("c") <= REGION)).select("prefix", "doc_id", (F.col("c") > REGION).alias("large"))
        done = here if done is None else done.unionByName(here)
        rows = inside.filter(F.col("c") > REGION).select("path", "doc_id", "label")
        if rows.isEmpty():
            break
    return settle(done, "leaves")


def fine_signatures(ids: DataFrame, docs: DataFrame, k: int, whole: bool = False) -> DataFrame:
    """doc_id, values (the finer signature) of the documents ids(doc_id), with whole also n and tokens (the set); of a doc_id with several texts, the set of all."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*utf8(column(part, "text")), k)
                out = [column(part, "doc_id"), pa.array([fine_signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
                if whole:
                    out += [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "values", "n", "tokens"][: len(out)])

    own = texts(docs).join(broadcast_if_small(ids), "doc_id", "left_semi")
    schema = "doc_id long, values binary" + (", n long, tokens binary" if whole else "")
    return settle(own.mapInArrow(run, schema).filter("values is not null").distinct(), "fine")


def homes_of(found: DataFrame) -> DataFrame:
    """doc_id, homes: hashes of the document's leaves by order, 0 for none."""
    order = F.conv(F.hex(F.substring("prefix", 1, 1)), 16, 10).cast("int")
    by_order = found.withColumn("order", order).groupBy("doc_id").agg(*(F.coalesce(F.max(F.when(F.col("order") == t, F.xxhash64("prefix"))), F.lit(0)).alias(f"h{t}") for t in range(TREES)))
    return settle(by_order.select("doc_id", F.array(*(f"h{t}" for t in range(TREES))).alias("homes")), "homes")


def leaf_blocks(found: DataFrame, label: DataFrame, fine: DataFrame, homes: DataFrame) -> DataFrame:
    """prefix, i (block), top (whether its documents are of the leaf's most frequent class), docs (doc_id, label, homes and the columns of fine) of the leaves found(prefix, doc_id) with several classes.

    Where fine has whole sets, blocks are bounded by their shingles too.
    """
    rows = _labelled(found.select("prefix", "doc_id"), label)
    n = F.lit(0)
    if "n" in fine.columns:
        rows, n = rows.join(fine.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id"), F.sum("n")
    rows = settle(rows, "leaf-rows")
    own = rows.groupBy("prefix", "label").agg(F.count("*").alias("c"), n.alias("n")).groupBy("prefix").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("n").alias("shingles"))
    mixed = settle(own.filter("labels > 1"), "mixed")
    dealt = rows.select("prefix", "doc_id", "label").join(small(mixed, 64), "prefix").withColumn("top", F.col("label") == F.col("most"))
    block = F.expr(f"pmod(xxhash64(doc_id), greatest(c div {PART}, shingles div {PART_SHINGLES}) + 1)").cast("int")
    signed = fine.select([c for c in fine.columns if c != "n"])
    docs = F.collect_list(F.struct("doc_id", "label", "homes", *signed.columns[1:]))
    return dealt.join(signed, "doc_id").join(homes, "doc_id").groupBy("prefix", "top", block.alias("i")).agg(docs.alias("docs"))


def _side(batch: pa.RecordBatch, name: str, n: int) -> tuple:
    """doc_id, label, values and homes of a block's documents, and the rows that they are of."""
    rows = column(batch, name).slice(n, 1).flatten()
    return rows.field("doc_id").to_numpy(), rows.field("label").to_numpy(), _rows_of(rows.field("values"), np.uint64), rows.field("homes").flatten().to_numpy().reshape(-1, TREES), rows


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """a, b: links between documents of different classes in one leaf, counted exactly over the whole sets (tokens) of the blocks, stored.

    Of the links of two blocks, those are left out whose classes others of them join already; so are pairs of
    finer signatures that are apart.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for n in range(batch.num_rows):
                (*left, x), (*right, y) = (_side(batch, c, n) for c in ("left", "right"))
                found = _linked(*left, _sets_of(x.field("tokens")), *right, _sets_of(y.field("tokens")), column(batch, "prefix")[n].as_py()[0], percent)
                if found:
                    a, b = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    blocks = settle(blocks, "blocks")
    x = blocks.select("prefix", F.col("top").alias("tx"), F.col("i").alias("ix"))
    y = blocks.select("prefix", F.col("top").alias("ty"), F.col("i").alias("iy"))
    # numbers of blocks meet first, so that a leaf's pairs of blocks are spread over tasks
    pairs = x.join(y, "prefix").filter("not tx and (ty or ix <= iy)")
    left = blocks.select("prefix", F.col("top").alias("tx"), F.col("i").alias("ix"), F.col("docs").alias("left"))
    right = blocks.select("prefix", F.col("top").alias("ty"), F.col("i").alias("iy"), F.col("docs").alias("right"))
    met = pairs.join(left, ["prefix", "tx", "ix"]).join(right, ["prefix", "ty", "iy"]).select("prefix", "left", "right")
    out = settle(met.mapInArrow(run, "a long, b long").distinct(), "block-links")
    forget(blocks)
    return out


def _sets_of(tokens: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(tokens)
    flat = data.copy().view(np.uint64)
    return [flat[a // 8 : b // 8] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _linked(da, la, va, ha, ta, db, lb, vb, hb, tb, order: int, percent: int) -> list[tuple[int, int]]:
    la, lb = la.copy(), lb.copy()  # classes, as the links found so far join them
    size = np.array([len(t) for t in tb])
    out = []
    for i, (doc, own) in enumerate(zip(da, ta, strict=True)):
        j = np.flatnonzero(lb != la[i])
        j = j[agreeing(va[i], vb[j]) >= FINE_AGREE]
        # a pair that an earlier order has in one leaf is that order's
        j = j[~((ha[i, :order] == hb[j, :order]) & (ha[i, :order] != 0)).any(axis=1)]
        if not len(j):
            continue
        tokens = np.concatenate([tb[x] for x in j])
        hit = own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens
        both = np.add.reduceat(hit, np.cumsum(size[j]) - size[j], dtype=np.int64)
        for x in j[(both > 0) & (100 * both >= percent * (len(own) + size[j] - both))]:
            if lb[x] != la[i]:
                out.append((doc, db[x]))
                old = lb[x]
                la[la == old] = la[i]
                lb[lb == old] = la[i]
    return out


def close_pairs(blocks: DataFrame, best: bool) -> DataFrame:
    """a, b, agree of the documents of different classes in one leaf whose finer signatures are close, from the first order that has both in one leaf; with best, the best one of each document and block."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for n in range(batch.num_rows):
                left, right = (_side(batch, c, n)[:4] for c in ("left", "right"))
                yield from _close(*left, *right, column(batch, "prefix")[n].as_py()[0], best)

    x = blocks.select("prefix", F.col("top").alias("tx"), F.col("i").alias("ix"), F.col("docs").alias("left"))
    y = blocks.select("prefix", F.col("top").alias("ty"), F.col("i").alias("iy"), F.col("docs").alias("right"))
    # documents of the most frequent class are met by the others alone, two blocks of others once
    pairs = x.join(y, "prefix").filter("not tx and (ty or ix <= iy)").select("prefix", "left", "right")
    found = pairs.mapInArrow(run, "a long, b long, agree long")
    return found.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _rows_of(values: pa.Array, kind) -> np.ndarray:
    return utf8(values)[0].copy().view(kind).reshape(len(values), -1)


def _close(da, la, va, ha, db, lb, vb, hb, order: int, best: bool) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(da), 32):  # 2 MB of differences at once
        own = slice(at, at + 32)
        agree = agreeing(va[own, None, :], vb[None, :, :])
        agree[la[own, None] == lb[None, :]] = 0
        if best:
            i, j = np.arange(len(agree)), agree.argmax(axis=1)
            good = agree[i, j] >= FINE_AGREE
            i, j = i[good], j[good]
        else:
            i, j = np.nonzero(agree >= FINE_AGREE)
        # a pair that an earlier order has in one leaf is that order's
        left = ha[own][i, :order]
        new = ~((left == hb[j, :order]) & (left != 0)).any(axis=1)
        i, j = i[new], j[new]
        if len(i):
            p, q = da[own][i], db[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(agree[i, j].astype(np.int64))], names=["a", "b", "agree"])


def classes(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for every row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = settle(signatures(docs, k), "signatures")
    with_set = own.filter("n > 0 and doc_id is not null")
    reps = settle(with_set.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("values").alias("values")), "reps")
    signed = reps.select(F.col("rep").alias("doc_id"), "values")
    # rows of one doc_id with different sets are linked
    several = with_set.groupBy("doc_id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("doc_id")
    named = with_set.select("doc_id", "sig").join(broadcast_if_small(settle(several, "several")), "doc_id").join(reps.select("sig", "rep"), "sig")
    label = components(named.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    forest = settle(paths(signed), "forest")
    beside = neighbours(forest)
    release(spark)
    tried = spark.createDataFrame([], "a long, b long")

    def verify(pairs: DataFrame) -> bool:
        """Whether any of the pairs(a, b), which haven't been tried, is linked; label and tried follow."""
        nonlocal label, tried
        pairs = settle(pairs.select("a", "b"), "tried")
        if pairs.isEmpty():
            return False
        links = verified(pairs, docs, k, percent)
        found = not links.isEmpty()
        label, tried = _joined(label, links), tried.unionByName(pairs)
        release(spark)
        return found

    def untried(pairs: DataFrame) -> DataFrame:
        return pairs.join(tried, ["a", "b"], "left_anti")

    verify(likely(_best(beside, ["times", "depth"]), signed))
    other = settle(likely(untried(_across(beside.select("a", "b"), label)), signed), "likely")
    verify(_best(other, ["agree"]))
    other = settle(untried(_across(other.select("a", "b"), label)), "others")
    found = leaves(forest, label)
    ids = settle(found.select("doc_id").unionByName(other.select(F.col("a").alias("doc_id"))).unionByName(other.select(F.col("b").alias("doc_id"))).distinct(), "close-ids")
    fine = fine_signatures(ids, docs, k)
    verify(likely(other, fine, FINE_AGREE, np.uint64))
    homes = homes_of(found)
    large, rest = found.filter("large"), found.filter("not large")
    if not large.isEmpty():
        whole = fine_signatures(settle(large.select("doc_id").distinct(), "large-ids"), docs, k, True)
        links = block_links(leaf_blocks(large, label, whole, homes), percent)
        label = _joined(label, links)
        forget(whole, links)
        release(spark)
    for _ in range(BEST_TURNS):
        best = settle(untried(close_pairs(leaf_blocks(rest, label, fine, homes), True)), "best")
        if not verify(_best(best, ["agree"])):
            break
    verify(untried(close_pairs(leaf_blocks(rest, label, fine, homes), False)))
    forget(other, found, ids, fine, homes)
    forget(forest, beside, tried)
    named = settle(reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("label", "rep").alias("label")), "named")
    forget(reps)
    alone = (F.col("n") == 0) | F.col("doc_id").isNull() | F.col("label").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("label"))
    return own.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
