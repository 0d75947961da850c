"""Pieces against the tokenizer library, sequences without gaps, and what the local search saves."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P

from heftgraph.llm import packing
from test_operators import mixed, table


def gapless(rows, room):
    """The pieces of every sequence lie side by side from 0 on, within room."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


def pieces(ids, room):
    """(piece, start, length, crc) of one document, in plain Python."""
    first = len(ids) % room or room
    edges = [0, *range(first, len(ids) + 1, room)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def test_against_the_library(spark):
    from tokenizers import Tokenizer

    texts = mixed()
    rows = packing.pack_documents(table(spark, texts), P.path("byte_bpe_50k.json"), 2, 64, group=40).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == pieces([*tok.encode(t or "", add_special_tokens=False).ids, 2], 64)
    assert gapless(rows, 64) <= 1.05 * sum(r["length"] for r in rows) / 64 + 3


def test_odd_rows(spark):
    """Null and repeated ids, clashing columns, an empty table; equal rows are dealt to groups like others."""
    rows = [(None, ""), (None, None), (1, "a b c"), (1, "a b c"), (1, "d " * 300), (2, "e")] + [(None, "")] * 50
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, piece int, group long")
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), 2, 64, group=8).collect()
    assert gapless(got, 64) and sum(r["length"] == 1 and r["doc_id"] is None for r in got) == 52
    assert sorted(r["start"] for r in got if r["doc_id"] == 1 and r["piece"] == 0) == [0, 0, 0]
    assert packing.pack_documents(df.filter("false"), P.path("byte_bpe_50k.json"), 2, 64).count() == 0


def test_search_saves_sequences():
    """Sizes that fill sequences exactly: best fit leaves gaps, the search closes most of them."""
    r = random.Random(1)
    for parts in (3, 4):
        sizes, best = [], 2048 // parts
        for _ in range(best):
            while True:
                at = sorted(r.randint(150, 874) for _ in range(parts - 1))
                own = [b - a for a, b in zip([0, *at], [*at, 1024])]
                if min(own) > 120:
                    break
            sizes += own
        before = packing.best_fit(sizes, 1024)
        after = packing.local_search(sizes, before, 1024)
        assert sorted(i for b in after for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in after)
        squares = [sum(sum(sizes[i] for i in b) ** 2 for b in bins) for bins in (before, after)]
        assert squares[1] > squares[0] and best <= len(after) <= len(before) - 5


def test_search_empties_a_bin():
    """6 + 4 against 5 + 5, in bins of 16: only an exchange makes room."""
    assert sorted(map(len, packing.local_search([6, 5, 5, 6, 5, 5], [[0, 1], [2, 3], [4, 5]], 16, 1.0))) == [3, 3]
    assert packing.local_search([], [], 16) == []
