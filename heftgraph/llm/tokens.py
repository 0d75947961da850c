"""Token ids of whole texts through a bounded memo of text chunks.

A text is cut only where no pre-token and no normalisation can reach across: before a space or a
line feed between two characters that aren't white space, and after such a line feed. Every chunk
not yet in the memo is encoded by the tokenizers library (or counted by another function); all
others are gathered from the memo by their 64-bit hash. Texts holding a special token's string or
white space beyond ASCII go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from heftgraph.llm.words import _rng, spans_hash

_CASED = _rng.integers(1, (1 << 63) - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII bytes that some library counts as white space.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def exotic_space(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 white space beyond ASCII: U+0085, 00A0, 1680, 180E, 2000-200F, 2028-202F, 205F, 3000, FEFF."""
    lead = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3, 0xEF)))
    lead = lead[lead + 1 < len(data)]
    a, b = data[lead], data[lead + 1]
    c = data[np.minimum(lead + 2, len(data) - 1)]
    hit = (a == 0xC2) & np.isin(b, (0x85, 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xEF) & (b == 0xBB)
    return lead[hit]


def cut_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk of every text, and the end; chunks tile the texts."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    solid = ~_BLANK[data]
    mid = np.flatnonzero((data == 0x20) | (data == 0x0A))
    mid = mid[(mid > 0) & (mid < n - 1)]
    mid = mid[solid[mid - 1] & solid[mid + 1]]
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True
    mid = mid[~inner[mid] & ~inner[mid + 1]]
    cut[mid] = True
    cut[mid[data[mid] == 0x0A] + 1] = True
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


class ChunkMemo:
    """Arrays of integers by chunk hash; at most limit chunks and 8 x limit values, then it starts anew."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, keys: np.ndarray, chunks: list[str]) -> None:
        flat, size = self.encode(chunks)
        if len(self.keys) + len(keys) > self.limit or self.used + len(flat) > 8 * self.limit:
            self.clear()
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used, 1 << 16), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        p = np.searchsorted(self.keys, keys)
        p[p == len(self.keys)] = 0
        return p

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the chunks one after the other, and how many each chunk has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, first, inverse = np.unique(spans_hash(data, starts, ends, _CASED), return_index=True, return_inverse=True)
        for again in range(2):
            p = self._places(keys) if len(self.keys) else np.zeros(len(keys), np.int64)
            new = np.flatnonzero(self.keys[p] != keys) if len(self.keys) else np.arange(len(keys))
            if not len(new):
                break
            if again or len(self.keys) + len(new) > self.limit:  # room for all of this look-up, however large
                self.clear()
                new = np.arange(len(keys))
            buf = data.tobytes()
            self.limit = max(self.limit, len(new))
            self._add(keys[new], [buf[starts[i] : ends[i]].decode() for i in first[new].tolist()])
            if len(new) < len(keys) and len(self.keys) == len(new):
                continue  # the memo started anew
            p = self._places(keys)
            break
        size = self.size[p].astype(np.int64)[inverse]
        at = self.at[p][inverse]
        total = int(size.sum())
        lead = np.cumsum(size) - size
        return self.pool[np.repeat(at - lead, size) + np.arange(total)], size


def batch_encoder(tok) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of many chunks by the tokenizers library, one after the other, and how many each has."""

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        size: list[int] = []
        for lo in range(0, len(chunks), 2000):
            for x in tok.encode_batch_fast(chunks[lo : lo + 2000], add_special_tokens=False):
                ids = x.ids
                flat += ids
                size.append(len(ids))
        return np.array(flat, np.uint32), np.array(size, np.int64)

    return encode


class Ids:
    """Ids of whole texts by a tokenizers file; special strings are found as the library does by default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.memo = ChunkMemo(batch_encoder(self.tok))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 places where each text's begin."""
        return encode_all(data, offsets, self.special, self.memo, lambda x: np.array(self.tok.encode(x, add_special_tokens=False).ids, np.uint32))


def encode_all(data, offsets, special: Sequence[bytes], memo: ChunkMemo, whole: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    odd = np.zeros(n, bool)
    odd[np.searchsorted(offsets[1:], exotic_space(data), side="right")] = True
    buf = data.tobytes()
    for s in special:
        at = buf.find(s)
        while at >= 0:
            odd[int(np.searchsorted(offsets[1:], at, side="right"))] = True
            at = buf.find(s, at + 1)
    starts, ends = cut_chunks(data, offsets)
    doc = np.searchsorted(offsets[1:], starts, side="right")
    plain = ~odd[doc]
    flat, size = memo.look_up(data, starts[plain], ends[plain])
    count = np.bincount(doc[plain], weights=size, minlength=n).astype(np.int64)
    if not odd.any():
        return flat, np.concatenate([[0], np.cumsum(count)])
    lead = np.concatenate([[0], np.cumsum(count)])
    parts = []
    for i in range(n):
        parts.append(whole(buf[offsets[i] : offsets[i + 1]].decode()) if odd[i] else flat[lead[i] : lead[i + 1]])
        count[i] = len(parts[-1])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(count)])


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One encoder and memo per worker process and file."""
    return Ids(path)
