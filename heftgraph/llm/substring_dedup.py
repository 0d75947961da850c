"""Substring dedup: paragraph MinHash banding over content-anchored paragraphs.

Repeated passages needn't stand in lines of their own. So a paragraph here is UNIT words from an
anchor on; anchors are the least 5-word shingles of every REACH in a row, hence the same wherever a
passage stands, and any run of 50 repeated words holds at least one whole paragraph, mostly several.
Each paragraph has BANDS keys of ROWS minima over its shingles. Two steps find the repeats:

1. Documents that share a key meet the first document of it in a star. Whole texts are compared:
   windows of min_words words around equal paragraphs that both texts have are spans; around other
   collisions words are followed across edits of up to UNIT words to either side, and what is so
   joined must reach the Jaccard similarity, counted over all its shingles.
2. A paragraph that no found span covers is one that its key's first document has only as a
   fragment (a common line, a phrase). Here the key says too little, so the words around it are
   taken in: the hash of every window of min_words words that holds the paragraph, and MinHash keys
   of wider contexts. Documents that share one of these meet its first document in a star again.

Whatever passage of min_words words two documents share word for word holds a paragraph of both. So
step 1 finds it, or the later document's paragraph is covered, or both paragraphs are open and the
passage is a window of step 2, whose first document has it too. Hence no such window is left in two
documents, however many share fragments of it; every step makes at most one pair a row. Repeats with
edits are found with the probability of the bands. Spans of at least min_words words are removed from
the later document, always in favour of a document with a smaller doc_id, so one copy stays;
removals are clustered by the connected components of those links.

Results for odd input: null, empty and short texts (under min_words words) lose nothing; repeats
within one document stay; repeated rows of a doc_id are treated alike if their texts are equal, and
lose nothing if not; documents with a null doc_id lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import broadcast_if_small, column, forget, free_name, release, settle, slices, texts, utf8
from heftgraph.llm.links import compared, components
from heftgraph.llm.words import grams, mix, spans_hash, window_hashes, word_spans

SHINGLE = 5
UNIT = 25
REACH = 26
MIN_WORDS = 50
SPAN = "doc_id long, start_word int, end_word int, start_byte long, end_byte long, leader long"
_SPAN = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("leader", pa.int64())])


def tune(similarity: float, recall: float, paragraphs: int, rows: int = 2) -> int:
    """Least bands of rows minima that find a passage of so many paragraphs of this similarity with this probability."""
    bands = 1
    while (1 - similarity**rows) ** (bands * paragraphs) > 1 - recall:
        bands += 1
    return bands


ROWS = 2
#: 4: 50 words are sure to hold one paragraph; at similarity 0.8 that one is missed in 1.7 % of cases, at 1.0 never.
BANDS = tune(0.8, 0.98, 1, ROWS)
#: Keys of the contexts of step 2: a passage that is shared whole is found in most cases, a mere fragment seldom.
CONTEXT_ROWS, CONTEXT_BANDS = 3, 4
#: Collisions that are followed together.
BLOCK = 2048
#: Spans whose places are sent to all tasks: 32 bytes each at most.
SENT_SPANS = 500_000
_SEEDS = np.random.default_rng(7).integers(1, (1 << 63) - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _banded(own: np.ndarray, first_seed: int, bands: int, rows: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets x bands) keys of the rows of own, and the place of each band's first minimum."""
    keys, places = np.empty((len(own), bands), np.uint64), np.empty((len(own), bands), np.int64)
    at = np.arange(len(own))
    for b in range(bands):
        key = np.full(len(own), salt + b, np.uint64)
        for r in range(rows):
            ranks = mix(own * _SEEDS[first_seed + b * rows + r])
            least = ranks.argmin(axis=1)
            key = mix(key + ranks[at, least])
            if not r:
                places[:, b] = least
        keys[:, b] = key
    return keys, places


def _shingles(words: np.ndarray) -> np.ndarray:
    """A hash for the shingle at every word; the last ones of all, which have too few words, are 0."""
    h = np.zeros(len(words), np.uint64)
    if len(words) >= SHINGLE:
        h[: len(words) - SHINGLE + 1] = grams(words, np.zeros(len(words), np.int8), tuple(range(SHINGLE)))[0]
    return h


def paragraphs(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index of each paragraph's anchor, its (paragraphs x BANDS) keys, and the words at which their first minima stand."""
    none = np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64), np.zeros((0, BANDS), np.int64)
    if len(words) < REACH + SHINGLE:
        return none
    h = _shingles(words)
    starts = np.flatnonzero(doc[: len(doc) - (REACH + SHINGLE - 2)] == doc[REACH + SHINGLE - 2 :])
    if not len(starts):
        return none
    view = np.lib.stride_tricks.sliding_window_view(h, REACH)
    # in blocks, since taking windows copies them
    least = np.zeros(len(words), bool)
    for s in np.array_split(starts, len(starts) // 50_000 + 1):
        least[s + view[s].argmin(axis=1)] = True
    anchor = np.flatnonzero(least)
    anchor = anchor[anchor + UNIT <= len(words)]
    anchor = anchor[doc[anchor] == doc[anchor + UNIT - 1]]
    if not len(anchor):
        return none
    parts = [_banded(h[a[:, None] + np.arange(UNIT - SHINGLE + 1)], 0, BANDS, ROWS, 0) for a in np.array_split(anchor, len(anchor) // 20_000 + 1)]
    return anchor, np.concatenate([p[0] for p in parts]), anchor[:, None] + np.concatenate([p[1] for p in parts])


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, doc = word_spans(data, offsets)
    return spans_hash(data, starts, ends), starts, ends, doc


def band_keys(docs: DataFrame, min_words: int) -> DataFrame:
    """key, doc_id, lo, hi: the keys of every document of at least min_words words, and the words of their paragraphs (overlapping ones joined)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, _, _, doc = _words(*utf8(column(part, "text")))
                anchor, keys, _ = paragraphs(words, doc)
                size = np.bincount(doc, minlength=part.num_rows)
                enough = size[doc[anchor]] >= min_words
                of = doc[anchor][enough]
                lo = np.repeat(anchor[enough] - (np.cumsum(size) - size)[of], BANDS)
                flat, of = keys[enough].ravel(), np.repeat(of, BANDS)
                order = np.lexsort((lo, flat, of))
                flat, of, lo = flat[order], of[order], lo[order]
                new = np.ones(len(of), bool)
                new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1]) | (lo[1:] > lo[:-1] + UNIT)
                at = np.flatnonzero(new)
                top = np.append(lo[at[1:] - 1], lo[-1:]) + UNIT
                yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), column(part, "doc_id").take(pa.array(of[at])), pa.array(lo[at], pa.int32()), pa.array(top, pa.int32())], names=["key", "doc_id", "lo", "hi"])

    return docs.mapInArrow(run, "key long, doc_id long, lo int, hi int")


def context_keys(open_: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """key, doc_id: what the words around the open paragraphs (doc_id, lo, hi) are found by."""
    # the paragraphs of one document; all of them bound the bytes of the lists
    few = open_.limit(SENT_SPANS + 1).count() <= SENT_SPANS
    listed = open_.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("open"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, _, _, doc = _words(*utf8(column(part, "text")))
                size = np.bincount(doc, minlength=part.num_rows)
                first = np.cumsum(size) - size
                held = column(part, "open")
                of = np.repeat(np.arange(part.num_rows), np.diff(held.offsets.to_numpy()))
                flat = held.flatten()
                lo, hi = (flat.field(k).to_numpy().astype(np.int64) + first[of] for k in (0, 1))
                last = (first + size)[of] - min_words
                a, b = np.maximum(lo - (min_words - UNIT), first[of]), np.minimum(hi - UNIT, last)
                windows = _ranges(a, b, len(words))
                keys, owner = [window_hashes(words, windows, min_words)], [doc[windows]]
                middle = (min_words - UNIT) // 2
                wide = np.unique(np.concatenate([np.clip(lo - d, first[of], last) for d in (min_words - UNIT, middle, 0)])) if len(lo) else np.zeros(0, np.int64)
                h = _shingles(words)
                for block in np.array_split(wide, len(wide) // 10_000 + 1):
                    if len(block):
                        k, _ = _banded(h[block[:, None] + np.arange(min_words - SHINGLE + 1)], BANDS * ROWS, CONTEXT_BANDS, CONTEXT_ROWS, BANDS)
                        keys.append(k.ravel())
                        owner.append(np.repeat(doc[block], CONTEXT_BANDS))
                key, own = np.concatenate(keys), np.concatenate(owner)
                order = np.lexsort((key, own))
                key, own = key[order], own[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), column(part, "doc_id").take(pa.array(own[new]))], names=["key", "doc_id"])

    return texts(docs).join(F.broadcast(listed) if few else listed, "doc_id").select("doc_id", "text", "open").mapInArrow(run, "key long, doc_id long")


def _ranges(lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """The distinct numbers of all lo..hi (both included) below size, ascending."""
    some = hi >= lo
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, lo[some], 1)
    np.add.at(depth, hi[some] + 1, -1)
    return np.flatnonzero(np.cumsum(depth) > 0)


def common_spans(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float, min_words: int) -> list[list[tuple[int, int]]]:
    """For pairs of texts, given by (words, number of the pair) of their left and right sides: the word spans of each right one that repeat in the left one.

    First the windows of min_words words around equal paragraphs are looked up among those of the
    left side. Paragraphs that collide without lying in a span so found are then followed word by word.
    """
    (wa, da), (wb, db) = a, b
    n = int(max(da[-1:].max(initial=-1), db[-1:].max(initial=-1))) + 1
    fa, fb = np.searchsorted(da, np.arange(n + 1)), np.searchsorted(db, np.arange(n + 1))
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    (pa_, ka, ea), (pb, kb, eb) = paragraphs(wa, da), paragraphs(wb, db)
    if not len(pa_) or not len(pb):
        return out
    salt_a, salt_b = mix(da.astype(np.uint64)), mix(db.astype(np.uint64))
    ka, kb = mix(ka + salt_a[pa_][:, None]), mix(kb + salt_b[pb][:, None])
    spans = _exact(wa, salt_a, pa_[np.isin(ka[:, 0], kb[:, 0])], fa[da], fa[da + 1], wb, salt_b, pb[np.isin(kb[:, 0], ka[:, 0])], fb[db], fb[db + 1], min_words)
    depth = np.zeros(len(wb) + 1, np.int64)
    np.add.at(depth, spans[:, 0], 1)
    np.add.at(depth, spans[:, 1], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(depth)[:-1] > 0)])
    open_ = covered[pb + UNIT] - covered[pb] < UNIT
    spans = np.concatenate([spans, _near(wa, wb, fa, fb, da, db, ka, ea, kb[open_], eb[open_], similarity, min_words)])
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    owner = db[spans[:, 0]] if len(spans) else np.zeros(0, np.int64)
    for p, (s, e) in zip(owner.tolist(), (spans - fb[owner][:, None]).tolist(), strict=True):
        if out[p] and s <= out[p][-1][1]:
            out[p][-1] = (out[p][-1][0], max(e, out[p][-1][1]))
        else:
            out[p].append((s, e))
    return out


def _exact(wa, salt_a, at_a, first_a, end_a, wb, salt_b, at_b, first_b, end_b, size: int) -> np.ndarray:
    """(start, end) on the right side of all windows of size words that hold one of the paragraphs at_b and stand on the left side around one of at_a, joined."""
    windows = []
    for words, salt, at, first, end in ((wa, salt_a, at_a, first_a, end_a), (wb, salt_b, at_b, first_b, end_b)):
        start = _ranges(np.maximum(at - (size - UNIT), first[at]), np.minimum(at, end[at] - size), len(words))
        windows.append((start, mix(window_hashes(words, start, size) + salt[start])))
    (_, left), (start, right) = windows
    start = start[np.isin(right, left)]
    if not len(start):
        return np.zeros((0, 2), np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > start[:-1] + size) | (salt_b[start[1:]] != salt_b[start[:-1]])
    at = np.flatnonzero(new)
    return np.stack([start[at], np.append(start[at[1:] - 1], start[-1]) + size], axis=1)


def _near(wa, wb, fa, fb, da, db, ka, ea, kb, eb, similarity: float, min_words: int) -> np.ndarray:
    """(start, end) on the right side of passages with edits around the open paragraphs' collisions (keys kb, minima eb), in blocks."""
    found = [np.zeros((0, 2), np.int64)]
    if not len(kb):
        return found[0]
    ga, gb = _shingles(wa), _shingles(wb)
    x, y = [], []
    for band in range(BANDS):
        order = np.argsort(ka[:, band], kind="stable")
        left = ka[order, band]
        lo, hi = np.searchsorted(left, kb[:, band], "left"), np.searchsorted(left, kb[:, band], "right")
        c = hi - lo
        x.append(ea[order[np.repeat(lo, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)], band])
        y.append(np.repeat(eb[:, band], c))
    x, y = np.concatenate(x), np.concatenate(y)
    same = (ga[x] == gb[y]) & (da[x] == db[y])
    pair = np.unique((y[same] << 32) | x[same])
    for at in range(0, len(pair), BLOCK):
        own = pair[at : at + BLOCK]
        found.append(_followed(wa, wb, ga, gb, own & 0xFFFFFFFF, own >> 32, fa, fb, db, similarity, min_words))
    return np.concatenate(found)


def _run(wa, wb, x, y, limit_a, limit_b, step: int, most: int) -> np.ndarray:
    """Words that agree from x and y on, to the right (step 1) or to the left (-1, x and y not counted), at most most of them and within the limits."""
    room = np.minimum((limit_a - x) * step, (limit_b - y) * step)
    by = np.arange(most) if step > 0 else -np.arange(1, most + 1)
    inside = np.arange(most) < room[:, None]
    agree = wa[np.where(inside, x[:, None] + by, 0)] == wb[np.where(inside, y[:, None] + by, 0)]
    return (np.logical_and.accumulate(agree & inside, axis=1)).sum(axis=1)


def _followed(wa, wb, ga, gb, x, y, fa, fb, db, similarity: float, min_words: int) -> np.ndarray:
    """(start, end) on the right side of the passages around the equal shingles at x and y.

    The run of agreeing words at x and y is taken together with the next run on either side, across
    an edit of up to UNIT words; of the parts so made the longest that is similar counts, measured by
    its common shingles in place. Longer passages are found part by part.
    """
    p, most = db[y], min_words
    left, right = _run(wa, wb, x, y, fa[p], fb[p], -1, most), _run(wa, wb, x, y, fa[p + 1], fb[p + 1], 1, most)
    _, once = np.unique(((y - left) << 32) | (x - left), return_index=True)
    x, y, n, p = (x - left)[once], (y - left)[once], (left + right)[once], p[once]
    a0, a1, b0, b1 = fa[p], fa[p + 1], fb[p], fb[p + 1]
    # the next shingles that are equal again, behind and before
    reach = np.arange(UNIT + 1)
    parts = {}
    for side in (1, -1):
        u, v = (x + n, y + n) if side > 0 else (x - SHINGLE, y - SHINGLE)
        at_a, at_b = u[:, None] + side * reach, v[:, None] + side * reach
        in_a, in_b = (at_a >= a0[:, None]) & (at_a + SHINGLE <= a1[:, None]), (at_b >= b0[:, None]) & (at_b + SHINGLE <= b1[:, None])
        ha, hb = ga[np.where(in_a, at_a, 0)], gb[np.where(in_b, at_b, 0)]
        equal = (ha[:, :, None] == hb[:, None, :]) & in_a[:, :, None] & in_b[:, None, :]
        cost = np.where(equal, ((reach[:, None] + reach) * (UNIT + 1) + reach[:, None]).astype(np.int32), np.int32(1 << 20)).reshape(len(x), -1)
        best = cost.argmin(axis=1)
        some = cost[np.arange(len(x)), best] < 1 << 20
        i, j = best // (UNIT + 1), best % (UNIT + 1)
        if side > 0:
            more = _run(wa, wb, u + i, v + j, a1, b1, 1, most)
        else:
            i, j = i - SHINGLE, j - SHINGLE  # to the shingle's end
            more = _run(wa, wb, u - i, v - j, a0, b0, -1, most)
            i, j = x - (u - i), y - (v - j)
        parts[side] = np.where(some, i, 0), np.where(some, j, 0), np.where(some, more, 0)
    (ri, rj, rn), (li, lj, ln) = parts[1], parts[-1]
    zero = np.zeros_like(n)
    start, end, long = np.zeros_like(n), np.zeros_like(n), zero - 1
    for with_left, with_right in ((0, 0), (1, 0), (0, 1), (1, 1)):
        la = n + with_left * np.where(ln > 0, li + ln, 0) + with_right * np.where(rn > 0, ri + rn, 0)
        lb = n + with_left * np.where(ln > 0, lj + ln, 0) + with_right * np.where(rn > 0, rj + rn, 0)
        common = n - SHINGLE + 1 + with_left * np.maximum(ln - SHINGLE + 1, 0) + with_right * np.maximum(rn - SHINGLE + 1, 0)
        either = (la - SHINGLE + 1) + (lb - SHINGLE + 1) - common
        good = (np.minimum(la, lb) >= min_words) & (common >= similarity * either) & (lb > long)
        start = np.where(good, y - with_left * np.where(ln > 0, lj + ln, 0), start)
        end = np.where(good, y + n + with_right * np.where(rn > 0, rj + rn, 0), end)
        long = np.where(good, lb, long)
    good = long > 0
    return np.stack([start[good], end[good]], axis=1)


def repeats(pairs: DataFrame, docs: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """SPAN rows of b's words that repeat in a, for pairs(a, b)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20, "text_b"):
                wa, _, _, da = _words(*utf8(column(part, "text_a")))
                wb, starts, ends, db = _words(*utf8(column(part, "text_b")))
                found = common_spans((wa, da), (wb, db), similarity, min_words)
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                if not len(row):
                    continue
                flat = np.array([s for f in found for s in f], np.int64)
                first = np.searchsorted(db, row)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([column(part, "b").take(of), pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32()), pa.array(_local(starts[first + flat[:, 0]], part, row)), pa.array(_local(ends[first + flat[:, 1] - 1], part, row)), column(part, "a").take(of)], schema=_SPAN)

    return compared(pairs, docs, run, SPAN, "spans")


def _local(at: np.ndarray, part: pa.RecordBatch, row: np.ndarray) -> np.ndarray:
    """Byte places within each row's text_b of places within all of them."""
    return at - utf8(column(part, "text_b"))[1][row]


def _stars(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(key, doc_id, ...) of keys that two documents have, with the key's first document as leader, those of the leaders left out; and the distinct pairs(a, b)."""
    heads = rows.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last").select("key", "leader")
    met = settle(rows.join(heads, "key").filter("doc_id <> leader").drop("key"), "met")
    return met, met.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()


def removals(docs: DataFrame, similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, end_word, start_byte, end_byte (UTF-8), n_words, kept_in, cluster_id of every removed span.

    min_words is 50 at least: fewer words needn't hold a paragraph.
    """
    if min_words < REACH + UNIT - 1:
        raise ValueError(f"passages of under {REACH + UNIT - 1} words needn't hold a paragraph")
    spark = docs.sparkSession
    release(spark)
    text_hash = F.xxhash64("text")
    mixed = settle(texts(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.min(text_hash).alias("lo"), F.max(text_hash).alias("hi")).filter("lo <> hi").select("doc_id"), "mixed")
    docs = texts(docs).filter("doc_id is not null").join(broadcast_if_small(mixed), "doc_id", "left_anti")
    keys = settle(band_keys(docs, min_words), "bands")
    met, pairs = _stars(keys)
    pairs = settle(pairs, "pairs")
    forget(keys)
    release(spark)
    first = repeats(pairs, docs, similarity, min_words)
    # the spans of one document
    covers = first.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    rest = met.select("doc_id", "lo", "hi").distinct().join(covers, "doc_id", "left").filter("spans is null or not exists(spans, s -> s.start_word <= lo and s.end_word >= hi)")
    open_ = settle(rest.select("doc_id", "lo", "hi"), "open")
    forget(met)
    wide = settle(context_keys(open_, docs, min_words), "contexts")
    met, more = _stars(wide)
    more = settle(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    forget(wide, met, open_)
    release(spark)
    second = repeats(more, docs, similarity, min_words)
    forget(pairs, more, mixed)
    found = first.unionByName(second).distinct()
    cluster = components(found.select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))).withColumnRenamed("node", "doc_id")
    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word", "start_byte", "end_byte", "leader")).alias("spans"))

    def merge(batches):
        for batch in batches:
            rows = []
            for doc, spans in zip(column(batch, "doc_id").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                out: list[dict] = []
                for s in sorted(spans, key=lambda s: (s["start_word"], -s["end_word"], s["leader"])):
                    if out and s["start_word"] <= out[-1]["end_word"]:
                        if s["end_word"] > out[-1]["end_word"]:
                            out[-1] |= {"end_word": s["end_word"], "end_byte": s["end_byte"]}
                        out[-1]["leader"] = min(out[-1]["leader"], s["leader"])
                    else:
                        out.append({"doc_id": doc} | s)
                rows += out
            yield pa.RecordBatch.from_pylist(rows, schema=_SPAN)

    merged = listed.mapInArrow(merge, SPAN)
    return merged.join(cluster, "doc_id", "left").select("doc_id", "start_word", "end_word", "start_byte", "end_byte", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("leader").alias("kept_in"), F.col("label").alias("cluster_id"))


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans (doc_id, start_byte, end_byte), n_chars counted anew; documents left without a word go."""
    held = free_name("spans", docs.columns)
    listed = settle(spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias(held)), "cuts")
    # a document of 50 words a span has 16 bytes a span, so the spans bound the bytes
    few = spans.limit(SENT_SPANS + 1).count() <= SENT_SPANS
    touched = docs.join(F.broadcast(listed) if few else listed, "doc_id", "inner")
    rest = docs.join(F.broadcast(listed.select("doc_id")) if few else listed.select("doc_id"), "doc_id", "left_anti")

    def run(batches):
        for batch in batches:
            out = []
            for text, own in zip(column(batch, "text").to_pylist(), column(batch, held).to_pylist(), strict=True):
                raw, at, parts = (text or "").encode(), 0, []
                for s in own:
                    parts.append(raw[at : s["start_byte"]])
                    at = max(at, s["end_byte"])
                out.append((b"".join([*parts, raw[at:]])).decode())
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))
            if "n_chars" in batch.schema.names:
                place = batch.schema.get_field_index("n_chars")
                batch = batch.set_column(place, "n_chars", pa.array([len(t) for t in out], batch.schema.field(place).type))
            yield batch

    done = touched.mapInArrow(run, touched.schema).drop(held).filter(F.length(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " "))) > 0)
    return rest.select(docs.columns).unionByName(done.select(docs.columns))
