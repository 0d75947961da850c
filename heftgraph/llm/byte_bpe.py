"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Results for odd input: null or empty texts have no ids (n_tokens 0, digests of no bytes); rows with
equal doc_id are encoded each; other columns aren't read; an empty table gives an empty table. Very
long texts are cut at safe places first, and long runs of white space are encoded apart.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heftgraph.llm.common import column, slices, texts

#: Texts longer than this many characters are cut before the library's pattern runs over them.
LONG_TEXT = 1 << 16
#: Runs of white space from this length on are not shown to the pattern, which would track back through them.
LONG_SPACE = 1 << 12
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
#: The characters with Unicode's White_Space property.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


def pre_split(text: str, size: int = LONG_TEXT) -> list[str]:
    """text in pieces of about size characters, cut before a lone space between two other characters.

    No match of the pattern spans such a place: a space is only ever the first character of a match
    that holds other characters, and white space before it there is none. Without such a place the
    piece runs on.
    """
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def without_long_space(text: str) -> list[tuple[str, bool]]:
    """text in pieces: long runs of white space (True), of each of which the pattern makes one match, and what lies between.

    A match of other characters never takes in white space behind it. Of a run, the pattern matches
    all at the end of the text, else all but the last character, which begins the next piece.
    """
    out, at = [], 0
    for m in _SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            out.append((text[at : m.start()], False))
        out.append((text[m.start() : end], True))
        at = end
    return [*out, (text[at:], False)] if at < len(text) else out


class Codec:
    """Encoding by ranks; every match of the pattern separately, no special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE:
            return self.library.encode_ordinary(text)
        out: list[int] = []
        for piece, space in without_long_space(text):
            if space:
                out += self.library._encode_single_piece(piece.encode())
            else:
                for part in pre_split(piece):
                    out += self.library.encode_ordinary(part)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes; they needn't be whole UTF-8."""
        return self.library.decode_bytes(ids)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as binary) of every whole text."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.array(c.encode(t), "<u4").tobytes() for t in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of every row of encode_documents()."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            raw = [c.decode(np.frombuffer(x, "<u4").tolist()) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode those ids, in one pass over the texts."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                n, a, b = [], [], []
                for t in column(part, "text").to_pylist():
                    ids = c.encode(t)
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
