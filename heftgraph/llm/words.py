"""Hashes of whole words and word shingles, vectorised over the bytes of many texts at once.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Each byte is mapped to
a random 64-bit value, prefix sums weighted by powers of an odd base give every word's polynomial
in two look-ups, and a final mix spreads it. Equality of shingles is equality of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BASE = int(_rng.integers(1 << 62, dtype=np.uint64)) * 2 + 1
_BYTE = _rng.integers(1, (1 << 63) - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_STEP = _rng.integers(1, (1 << 63) - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Bytes whose prefix sums are held at once.
WINDOW = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reserve(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of data[s:e] for ascending, disjoint spans; works in windows, so memory doesn't grow with data."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + WINDOW, side="right")))
        hi = int(ends[to - 1])
        _reserve(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * _powers[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * _inverses[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray, within: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, a run of the bytes within."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = within[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    starts, ends, doc = word_spans(data, offsets)
    return spans_hash(data, starts, ends), doc


def grams(words: np.ndarray, doc: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word tuples at positions i + gap of one text, and the text of each; (0, 1, 2) are trigrams."""
    reach = max(gaps)
    n = len(words) - reach
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
    h = np.zeros(n, np.uint64)
    for k, gap in enumerate(gaps):
        h += words[gap : gap + n] * _STEP[k] + _STEP[32 + len(gaps) + sum(gaps)]
    same = doc[:n] == doc[reach:]
    return mix(h[same]), doc[:n][same]


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each start on."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _reserve(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers[: len(words)], out=sums[1:])
    return mix((sums[starts + size] - sums[starts]) * _inverses[starts])


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingles of all texts as (hash, text), by text; a text of fewer words, but at least one, has its whole sequence as one."""
    h, of = grams(words, doc, tuple(range(k)))
    short, whole = short_texts(words, doc, n_docs, k)
    if len(short):
        h, of = np.concatenate([h, whole]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of


def short_texts(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of at least one but fewer than k words, and the hash of each one's whole sequence."""
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    at = np.cumsum(count) - count
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = count[short] > j
        whole[has] += words[at[short[has]] + j] * _STEP[j] + _STEP[20 + count[short[has]]]
    return short, mix(whole)


def weighted_sets(data: np.ndarray, offsets: np.ndarray, k: int, known: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ascending distinct k-word shingles of each text, each with the sum of its words' weights (0 for words not in known)."""
    n = len(offsets) - 1
    words, doc = hash_words(data, offsets)
    h, of = shingles(words, doc, n, k)
    own = np.zeros(len(words), np.int64)
    if len(known) and len(words):
        p = np.minimum(np.searchsorted(known, words), len(known) - 1)
        own = np.where(known[p] == words, weight[p], 0)
    m = max(len(words) - k + 1, 0)
    same = doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)
    total = sum((own[j : j + m] for j in range(k)), np.zeros(m, np.int64))[same]
    short, _ = short_texts(words, doc, n, k)
    if len(short):  # the single shingle of a short text keeps weight 0
        at = np.searchsorted(doc[:m][same], short)
        total = np.insert(total, at, 0)
    bounds = np.searchsorted(of, np.arange(n + 1))
    out = []
    for i in range(n):
        tokens, first = np.unique(h[bounds[i] : bounds[i + 1]], return_index=True)
        out.append((tokens, total[bounds[i] : bounds[i + 1]][first]))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The ascending distinct k-word shingles of each text."""
    n = len(offsets) - 1
    words, doc = hash_words(data, offsets)
    h, of = shingles(words, doc, n, k)
    bounds = np.searchsorted(of, np.arange(n + 1))
    return [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(n)]
