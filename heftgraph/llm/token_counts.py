"""Token counts of whole texts by rank-synchronous merging over ragged arrays.

The pre-tokens of many texts lie one after the other in one array of symbols. In each round every
sequence applies its own lowest-rank pair, wherever it stands in it, all sequences at once; when no
sequence has a pair with a rank left, the symbols that survive are counted. A sequence of more than
LONG bytes has rounds of its own, which touch only the places of the rank that they merge. Counts are
kept per chunk of text in a bounded memo, so each distinct chunk is merged about once in a worker.

Results for odd input: null or empty texts count 0; equal doc_ids are counted each; other columns
aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heftgraph.llm.common import column, slices, texts, utf8
from heftgraph.llm.tokens import ChunkMemo, encode_all

#: White space as the tokenizers library sees it, written out since Python's \\s differs.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split pattern of byte-level vocabularies.
_PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NONE = np.int64(1 << 40)
#: Bytes from which on a sequence is merged by itself.
LONG = 2048


def byte_alphabet() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class RankMerger:
    """Merges of a byte-level BPE file (model vocabulary and merge list)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec["model"].get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level file")
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_alphabet()
        self.symbol = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        made = [vocab[a + b] for a, b in pairs]
        self.made = np.array(made, np.int64)[order]
        self.parts = [(vocab[a], vocab[b], m) for (a, b), m in zip(pairs, made, strict=True)]
        self.pattern = regex.compile(_PRE_TOKEN)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE if it has none) and its place in the table."""
        key = (left << 20) | right
        p = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[p] == key, self.rank[p], _NONE), p

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence (none empty) after all merges."""
        size = np.array([len(s) for s in sequences], np.int64)
        result = size.copy()
        sym = self.symbol[np.frombuffer(b"".join(sequences), np.uint8)]
        seq = np.repeat(np.arange(len(sequences)), size)
        while len(sym) > 1:
            pair = np.full(len(sym), _NONE)
            where = np.zeros(len(sym), np.int64)
            together = seq[:-1] == seq[1:]
            pair[:-1], where[:-1] = self.ranks(sym[:-1], sym[1:])
            pair[:-1][~together] = _NONE
            first = np.flatnonzero(np.concatenate([[True], ~together]))
            lowest = np.minimum.reduceat(pair, first)
            live = lowest < _NONE
            length = np.diff(np.append(first, len(sym)))
            result[seq[first[~live]]] = length[~live]
            if not live.any():
                return result
            hit = (pair == np.repeat(lowest, length)) & (pair < _NONE)
            # of overlapping places (aaa) every second one from the left of each run counts
            run = hit & np.concatenate([[False], hit[:-1]])
            if run.any():
                start = np.flatnonzero(hit & ~run)
                at = np.flatnonzero(hit)
                nth = at - start[np.searchsorted(start, at, side="right") - 1]
                hit[at[nth % 2 == 1]] = False
            sym = np.where(hit, self.made[where], sym)
            keep = np.repeat(live, length)
            keep[1:] &= ~hit[:-1]
            sym, seq = sym[keep], seq[keep]
        if len(sym):
            result[seq[0]] = 1
        return result

    def count_long(self, sequence: bytes) -> int:
        """Symbols left of one sequence: a round a rank over the places that wait for it, with links between the symbols that live."""
        n = len(sequence)
        sym = self.symbol[np.frombuffer(sequence, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        left = n

        def wait(at: np.ndarray) -> None:
            rank, _ = self.ranks(sym[at], sym[after[at]])
            some = np.flatnonzero(rank < _NONE)
            order = some[np.argsort(rank[some], kind="stable")]
            rank, at = rank[order], at[order]
            cut = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a < b:
                    own = int(rank[a])
                    if own not in waiting:
                        waiting[own] = []
                        heapq.heappush(queue, own)
                    waiting[own].append(at[a:b])

        wait(np.arange(n - 1))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            x, y, made = self.parts[rank]
            at = at[(sym[at] == x) & (after[at] < n)]
            at = at[sym[after[at]] == y]
            if x == y and len(at) > 1:  # of overlapping places every second one
                start = np.concatenate([[True], at[1:] != after[at[:-1]]])
                at = at[(np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = made, -1
            after[at] = after[gone]
            before[after[at]] = at
            left -= len(at)
            near = np.unique(np.concatenate([at, before[at]]))
            wait(near[(near >= 0) & (after[near] < n)])
        return left

    def count_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One value a chunk: the tokens of all its pre-tokens."""
        split = [self.pattern.findall(c) for c in chunks]
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        new = list({p for parts in split for p in parts if p not in known})
        raw = [p.encode() for p in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        for lo in range(0, len(short), 20_000):
            some = short[lo : lo + 20_000]
            known.update(zip([new[i] for i in some], self.count([raw[i] for i in some]).tolist(), strict=True))
        once = {p: self.count_long(r) for p, r in zip(new, raw, strict=True) if len(r) > LONG}  # too large to be kept
        return np.array([sum([once[p] if p in once else known[p] for p in parts]) for parts in split], np.uint32), np.ones(len(chunks), np.int64)

    def count_whole(self, text: str) -> int:
        """Tokens of a text that may hold special strings; each counts as one."""
        import regex

        parts = regex.split("|".join(map(regex.escape, self.special)), text) if self.special else [text]
        return len(parts) - 1 + int(self.count_chunks(parts)[0].sum())


class Counter:
    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.memo = ChunkMemo(self.merger.count_chunks)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        special = [s.encode() for s in self.merger.special]
        flat, bounds = encode_all(data, offsets, special, self.memo, lambda t: np.array([self.merger.count_whole(t)], np.uint32))
        sums = np.concatenate([[0], np.cumsum(flat.astype(np.int64))])
        return sums[bounds[1:]] - sums[bounds[:-1]]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_documents(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(column(part, "text"))
                n = c.count(data, offsets)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
