"""Long texts, long runs of white space and odd rows, against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from heftgraph.llm import byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS, P.PATTERN)


def test_long_texts_equal_the_library(codec):
    r = random.Random(2)
    spaces = [" ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\x85", "\x1c", "  "]
    for k in range(40):
        parts = []
        for _ in range(6):
            parts.append("".join(r.choices(["word", "'s", "12", "!?", "\u65e5\u672c", " ", "\n"], k=r.randint(0, 50))))
            parts.append("".join(r.choices(spaces[: r.randint(1, 9)], k=r.choice([1, 3, byte_bpe.LONG_SPACE - 1, byte_bpe.LONG_SPACE, 9000]))))
        text = "".join(parts[: -1 if k % 2 else None])
        assert codec.encode(text) == codec.library.encode_ordinary(text)


@pytest.mark.parametrize("space", [" ", "\n", "\t \r\n"])
@pytest.mark.parametrize("after", ["", "word", "!"])
def test_millions_of_white_space(codec, space, after):
    """The library itself fails on these; the run is one match, without its last character if something follows."""
    run = space * (2_000_000 // len(space))
    text = "start" + run + after
    head = run if not after else run[:-1]
    tail = after and run[-1] + after
    want = codec.library.encode_ordinary("start") + codec.library._encode_single_piece(head.encode()) + codec.library.encode_ordinary(tail)
    assert codec.encode(text) == want
    assert codec.decode(want) == text.encode()


def test_odd_rows(spark):
    texts = [(1, "a b"), (1, None), (None, " \n" * 5000), (2, ""), (2, "x" * 200_000)]
    df = spark.createDataFrame([(*t, 3) for t in texts], "doc_id long, text string, n_tokens int")
    got = byte_bpe.round_trip_digests(df, RANKS, P.PATTERN)
    sums = sorted(r["decoded_sha256"] for r in got.collect())
    assert sums == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts)
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode_documents(df.filter("text = 'a b'"), RANKS, P.PATTERN).collect()}
    assert np.frombuffer(ids[1], "<u4").tolist() == byte_bpe.Codec(RANKS, P.PATTERN).library.encode_ordinary("a b")
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(r["bytes"] for r in back.collect()) == sorted((t or "").encode() for _, t in texts)
    assert byte_bpe.round_trip_digests(df.filter("false"), RANKS, P.PATTERN).count() == 0
