"""Operators against brute force and the libraries, on small tables with odd rows and clashing extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from heftgraph.llm import byte_bpe, html_text, jaccard_join, orc_ids, substring_dedup, token_counts, toxicity
from heftgraph.llm.common import scratch_path

ODD = ["", None, " ", "a", "it's 'twas\n\n  b\t c \r\n", "x <|endoftext|> y  <|endoftext|>", "naïve x  é　日本", "word " * 30_000, "A b C", "a B c", "½ ²³ 12\x1c3"]


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", "src", 1, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, label int")


def mixed(n=60):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(1, 140))) for _ in range(n)]
    near = []
    for t in base[:25]:
        w = t.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        near.append(" ".join(w))
    return base + near + base[:5] * 3 + ODD


def brute_classes(texts, k, percent):
    def tokens(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [tokens(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        before = list(label)
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)  # so that combinations are indexed here too
    texts = mixed()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(table(spark, texts), k, percent).collect()}
    assert got == brute_classes(texts, k, percent)


def test_jaccard_join_splits_large_buckets(spark, monkeypatch):
    """Many different documents share rare-looking tokens; those that are linked are still all found."""
    r = random.Random(12)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(60)]
    common = [r.choices(words, k=12) for _ in range(4)]
    texts = []
    for _ in range(70):
        parts = [*r.sample(common, 2)[0], *r.choices(words, k=r.randint(2, 12)), *r.choice(common)]
        texts.append(" ".join(parts))
        if r.random() < 0.5:
            parts[r.randrange(len(parts))] = "edit"
            texts.append(" ".join(parts))
    monkeypatch.setattr(jaccard_join, "SPLIT", 3)
    monkeypatch.setattr(jaccard_join, "STARS", 1)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1000)
    split = []
    plain = jaccard_join.index_tokens
    monkeypatch.setattr(jaccard_join, "index_tokens", lambda *a: split.append(1) or plain(*a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(table(spark, texts), 3, 60).collect()}
    assert split and got == brute_classes(texts, 3, 60)


def test_substring_dedup(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    passage = [word() for _ in range(60)]
    docs = [" ".join([*(word() for _ in range(80)), *passage, *(word() for _ in range(80))]) for _ in range(4)]
    clean = [" ".join(word() for _ in range(200)) for _ in range(4)]
    docs_df = table(spark, docs + clean + ODD)
    spans = substring_dedup.removals(docs_df)
    got = {r["doc_id"]: r for r in spans.collect()}
    assert set(got) == {1, 2, 3} and all(s["kept_in"] == 0 and s["n_words"] == 60 and s["cluster_id"] == 0 for s in got.values())
    after = {r["doc_id"]: r["text"] for r in substring_dedup.cut(docs_df, spans).collect()}
    assert " ".join(passage) in after[0] and all(" ".join(passage) not in after[i] for i in (1, 2, 3))
    assert [after[i] for i in range(4, 8)] == clean


def test_token_ids_and_counts(spark):
    from tokenizers import Tokenizer

    texts = mixed()
    docs = table(spark, texts)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_documents(docs, P.path("byte_bpe_50k.json"), 1024).collect()} == want
    codec = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in byte_bpe.round_trip_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        t = texts[r["doc_id"]] or ""
        ids = codec.library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_orc_round_trip(spark):
    from tokenizers import Tokenizer

    texts = mixed()
    path = scratch_path(spark, "test-orc")
    orc_ids.write_ids(table(spark, texts), path, P.path("word_bpe_49k.json"), 2)
    tok, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in orc_ids.digests(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert orc_ids.read_ids(spark, path).filter("doc_id = 3").count() == 1


def test_toxicity(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(600):
        w = r.choices(words, k=60)
        bad = i % 4 == 0
        texts.append(" ".join([*w, *(["vileword", "nastyword"] if bad else [])]))
        labels.append((i, int(bad)))
    docs = table(spark, texts + ODD)
    scores = {x["doc_id"]: x for x in toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scores[i]["held_out"] for i in held) and len(scores) == 600 + len(ODD)
    assert np.mean([scores[i]["predicted"] == labels[i][1] for i in held]) > 0.97


def test_html():
    model = html_text.trained()
    wrong = total = 0
    for x, y in html_text.made_up(77, 100):
        s = model.scores(*html_text.padded([x]))[:, 0] > 0
        wrong, total = wrong + int((s != (y > 0)).sum()), total + len(y)
    assert wrong <= 0.02 * total
    page = "<html><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>First  text\nhere, and more of it.</p><p><b>Second &eacute; part goes on for some words.<br></article><section class=comments><div class=comment><p>Nice one.</p></div></section><footer>&copy; X</footer></body></html>"
    assert html_text.main_texts([page, ""], model) == ["A & B\nFirst text here, and more of it.\nSecond é part goes on for some words.", ""]
    inline = "<article><p>super<wbr>cali<img src=x>fragil <math><mi>x</mi></math> <b>bold</b>ness<br>next line of the text.</p><script src=a/>var x=1;</script><p>Formula <svg><text>drawn</text></svg> shown here, said the author.</p></article>"
    assert [b[0] for b in html_text.blocks(inline)] == ["supercalifragil x boldness next line of the text.", "Formula drawn shown here, said the author."]
