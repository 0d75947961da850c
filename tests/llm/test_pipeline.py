"""The whole pipeline against a brute-force version of what each stage keeps."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from test_operators import brute_classes, table


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(400)]
    toxic = [i % 4 == 0 for i in range(400)]
    texts = [t + " vileword nastyword" * bad for t, bad in zip(texts, toxic, strict=True)]
    passage = " ".join("".join(r.choices("ijklmnop", k=6)) for _ in range(70))
    extra = [texts[1], texts[1], texts[2] + " end", "", None]
    carriers = [" ".join([*r.choices(words, k=90), "@"]) for _ in range(3)]
    texts += extra + [c.replace("@", passage) for c in carriers]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(b)) for i, b in enumerate(toxic)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids_crc32"]))
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    left = {i: t or "" for i, t in enumerate(texts) if i >= 400 or not toxic[i]}
    first = {}
    for i, t in left.items():
        first.setdefault(t, i)
    left = {i: t for i, t in left.items() if first[t] == i}
    ids = list(left)
    classes = brute_classes([left[i] for i in ids], 5, 80)
    left = {i: left[i] for n, i in enumerate(ids) if classes[n][1] == n}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    code = lambda t: [*tok.encode(t, add_special_tokens=False).ids, 2]
    assert set(pieces) == set(left)
    for i, t in left.items():
        own = sorted(pieces[i])
        choices = [t] if i < 406 else [t.replace(passage, ""), t.replace(" " + passage, "")]
        want = [code(c) for c in choices]
        assert any(all(zlib.crc32(np.array(w[s : s + n], "<u4").tobytes()) == c for _, s, n, c in own) and sum(n for _, _, n, _ in own) == len(w) for w in want), i
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
