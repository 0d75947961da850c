"""Repeats that hide behind the first documents of a key."""

import random

import pyarrow as pa
import pytest

from heftgraph.llm import substring_dedup
from heftgraph.llm.common import utf8
from test_operators import table


def made(seed):
    r = random.Random(seed)
    words = lambda n: ["".join(r.choices("abcdefghij", k=5)) for _ in range(n)]
    return words, lambda *parts: " ".join(w for p in parts for w in [*words(40), *p]) + " " + " ".join(words(40))


def left(spark, docs, passage):
    """Documents that still hold the whole passage."""
    df = table(spark, docs)
    after = substring_dedup.cut(df, substring_dedup.removals(df)).collect()
    return sorted(r["doc_id"] for r in after if " ".join(passage) in r["text"])


def test_leaders_that_hold_only_fragments(spark):
    words, doc = made(1)
    p = words(60)
    docs = [doc(p[:45]) for _ in range(3)] + [doc(p[15:]) for _ in range(3)] + [doc(p) for _ in range(4)]
    assert left(spark, docs, p) == [6]


def test_a_shared_footer_hides_no_other_repeat(spark):
    words, doc = made(2)
    footer, p = words(60), words(60)
    docs = [doc(footer, p[:45]), doc(footer, p[15:])] + [doc(footer, p) for _ in range(3)]
    assert left(spark, docs, p) == [2]
    assert left(spark, docs, footer) == [0]


def test_fragments_of_a_passage_before_it(spark):
    """Two documents share a passage, and two pairs of others share parts of it that are too short."""
    words, doc = made(4)
    p = words(60)
    docs = [doc(p[:45])] * 1 + [doc(p[:45]), doc(p[15:]), doc(p[15:]), doc(p), doc(p)]
    assert left(spark, docs, p) == [4]


def test_a_line_that_many_share_hides_no_passage(spark):
    words, doc = made(5)
    line = words(40)
    tails = [words(30) for _ in range(6)]
    docs = [doc(line) for _ in range(30)] + [doc([*line, *tails[k % 6]]) for k in range(18)]
    df = table(spark, docs)
    after = {r["doc_id"]: r["text"] for r in substring_dedup.cut(df, substring_dedup.removals(df)).collect()}
    for k, tail in enumerate(tails):
        assert [i for i, t in sorted(after.items()) if " ".join(tail) in t] == [30 + k]
    assert all(after[i] == docs[i] for i in range(36))


def test_a_passage_with_an_edit_is_one_passage():
    words, doc = made(3)
    lefts, rights, edits = [], [], []
    for k in range(100):
        p = words(60)
        edits.append([[*p[:30], "other", *p[31:]], [*p[:30], "new", *p[30:]], [*p[:30], *p[31:]]][k % 3])
        lefts.append(doc(p))
        rights.append(doc(edits[-1]))
    sides = []
    for many in (lefts, rights):
        w, _, _, of = substring_dedup._words(*utf8(pa.array(many)))
        sides.append((w, of))
    found = substring_dedup.common_spans(*sides, 0.8, 50)
    assert all(spans in ([], [(40, 40 + len(e))]) for spans, e in zip(found, edits, strict=True))
    assert sum(map(bool, found)) >= 85


def test_longer_passages_are_found_whole():
    """Edits every 30 words, near the ends too: parts that are similar join to the whole."""
    words, doc = made(8)
    p = words(200)
    q = list(p)
    for k in range(20, 200, 30):
        q[k : k + 1] = [["x", "y"], [], ["z"]][k // 30 % 3]
    sides = []
    for text in (doc(p), doc(q)):
        w, _, _, of = substring_dedup._words(*utf8(pa.array([text])))
        sides.append((w, of))
    (spans,) = substring_dedup.common_spans(*sides, 0.8, 50)
    assert len(spans) == 1 and spans[0][0] in (40, 60, 62) and spans[0][1] >= 40 + len(q) - 25


def window_repeats(texts, size=50):
    """Windows of size words that two documents hold, by plain sets."""
    first, twice = {}, set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            window = tuple(x.lower() for x in w[k : k + size])
            if first.setdefault(window, i) != i:
                twice.add(window)
    return twice


def test_no_window_is_left_twice(spark):
    """Every repeated 50-word window of made-up documents goes, whatever fragments, copies and edits are around."""
    r = random.Random(11)
    words, _ = made(6)
    pieces = [words(n) for n in (12, 25, 30, 40, 49, 50, 51, 60, 75, 120) for _ in range(3)]
    docs = []
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = list(r.choice(pieces))
            a = r.randint(0, len(p) // 3)
            p = p[a:] if r.random() < 0.5 else p[: len(p) - a]
            if r.random() < 0.2:
                p[r.randrange(len(p))] = "edit" + str(r.randint(0, 99))
            parts += [*p, *words(r.randint(0, 12))]
        docs.append(" ".join(parts))
    docs += docs[:10] + ["word " * 3000] * 2 + ["a b c " * 500, "b c a " * 400, None, "", " ".join(words(30))]
    df = table(spark, docs)
    assert len(window_repeats(docs)) > 1000
    spans = substring_dedup.removals(df)
    assert spans.filter("n_words < 50 or kept_in >= doc_id").count() == 0
    gone = {}
    for s in spans.collect():
        gone.setdefault(s["doc_id"], []).append((s["start_word"], s["end_word"]))
    kept = []
    for i, t in enumerate(docs):
        w = (t or "").split()
        for k, (a, b) in enumerate(sorted(gone.get(i, ()))):  # a mark of its own, so that no new window arises
            w[a:b] = [f"cut-{i}-{k}"] + [None] * (b - a - 1)
        kept.append(" ".join(x for x in w if x is not None))
    # a text that repeats itself may hold a window at another place again
    assert not {w for w in window_repeats(kept) if len(set(w)) > 3}


def test_odd_rows(spark):
    """Null and repeated ids, a column of the operator's own name, empty tables."""
    words, _ = made(7)
    p = " ".join(words(70))
    rows = [(1, p, "x"), (2, p, "x"), (None, p, "x"), (3, "é" + p, "x"), (3, "\u65e5 " + p[5:], "x"), (4, p, "x"), (4, p, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = substring_dedup.removals(df)
    assert {r["doc_id"] for r in got.collect()} == {2, 4}
    after = substring_dedup.cut(df, got)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in after.collect()) == sorted([(1, p), (0, p), (3, "é" + p), (3, "\u65e5 " + p[5:])])
    assert after.columns == df.columns
    assert substring_dedup.removals(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.removals(df, min_words=49)
