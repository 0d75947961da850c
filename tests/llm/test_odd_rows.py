"""Null and repeated ids, empty tables, very long texts, and extra columns with the operators' own names."""

import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from heftgraph.llm import html_text, jaccard_join, orc_ids, token_counts
from heftgraph.llm.common import free_name, scratch_path, scratch_root

BPE = P.path("byte_bpe_50k.json")
LONG = "many words and more of them " * 60_000
ROWS = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, None), (2, ""), (3, "one"), (4, LONG), (5, LONG)]


def frame(spark, rows=ROWS):
    names = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, n int, rest int, digest string, spans string, row long"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2, 3, "d", "s", 9) for i, t in rows], names)


def test_jaccard_join(spark):
    docs = frame(spark)
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.classes(docs, 3, 90).collect()))
    assert got == [(0, 4, 0), (0, 4, 0), (1, 1, 1), (1, 4, 1), (1, 4, 1), (2, 0, 2), (2, 0, 2), (3, 1, 3), (4, 6, 4), (5, 6, 4)]
    assert jaccard_join.classes(docs.filter("false"), 3, 90).count() == 0
    assert jaccard_join.classes(docs.filter("doc_id is null"), 3, 90).count() == 2


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_documents(frame(spark), BPE, 1024).collect())
    want = [(i or 0, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS]
    assert got == sorted((*w, w[2] > 1024) for w in want)
    assert token_counts.count_documents(frame(spark).filter("false"), BPE, 1024).count() == 0
    spec = json.load(open(BPE))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            token_counts.RankMerger(str(other))


def test_orc_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = scratch_path(spark, "odd-orc")
    orc_ids.write_ids(frame(spark), path, P.path("word_bpe_49k.json"), 2)
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i or 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in orc_ids.digests(spark, path).collect()) == sorted(want)
    empty = scratch_path(spark, "empty-orc")
    orc_ids.write_ids(frame(spark).filter("false"), empty, P.path("word_bpe_49k.json"), 2)
    assert orc_ids.digests(spark, empty).count() == 0


def test_orc_metadata_prunes(spark):
    """Files hold run-length ids, stripe statistics and Bloom filters; a look-up of one id reads few rows."""
    from pyarrow import orc

    path = scratch_path(spark, "pruned-orc")
    docs = spark.range(0, 60_000, 2).selectExpr("id as doc_id", "concat('w', id % 7) as text")
    orc_ids.write_ids(docs.repartition(4), path, P.path("word_bpe_49k.json"), 2)
    seen = orc_ids.read_ids(spark, path)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,30000)]" in seen.filter("doc_id = 30000")._jdf.queryExecution().toString()
    assert seen.filter("doc_id = 30000").count() == 1 and seen.filter("doc_id = 30001").count() == 0
    import glob

    files = glob.glob(f"{path}/*.orc")
    whole = {f: orc.ORCFile(f) for f in files}
    bounds = sorted((int(t["doc_id"].to_numpy().min()), int(t["doc_id"].to_numpy().max())) for t in (f.read(["doc_id"]) for f in whole.values()) if t.num_rows)
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))  # ranges of files don't overlap
    raw = b"".join(open(f, "rb").read() for f in files)
    assert len(raw) < 30_000 * 8  # ids and starts take less than their plain size
    assert all(f.row_index_stride == 1000 and f.nstripe_statistics == f.nstripes for f in whole.values())


def test_html(spark):
    page = "<html><body><article><h1>Title of it</h1><p>Some words that make a sentence, long enough to keep.</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", ""), (4, "x", "<p" * 50_000), (5, "y", "<div>" * 3000 + "deep"), (6, "z", "no markup at all, but a sentence.")]
    got = html_text.extract(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int"))
    texts = [(r["page_id"] or 0, r["text"]) for r in got.collect()]
    assert len(texts) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert {t for i, t in texts if i in (0, 1)} == {"Title of it\nSome words that make a sentence, long enough to keep."}
    assert [t for i, t in sorted(texts) if i in (2, 3)] == ["", ""]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Without labels nothing is rejected; null and repeated ids and foreign columns pass all stages."""
    passage = " ".join(f"p{k}" for k in range(60))
    other = " ".join(f"o{k}" for k in range(60))
    rows = [*ROWS, (6, "q " * 3 + passage), (7, f"{other} {passage}"), (8, f"{passage} é"), (8, f"日 {passage[8:]}"), (None, passage + " z")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.count() == len(rows)
    once = corpus_pipeline.drop_copies(spark, kept, str(tmp_path))
    left = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in once.collect())
    want = sorted([(-1, "a b c d e f"), (-1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, ""), (3, "one"), (4, LONG), *((i if i is not None else -1, t) for i, t in rows[10:])])
    assert left == want
    near = corpus_pipeline.drop_near_copies(spark, once, str(tmp_path))
    cut = corpus_pipeline.drop_repeats(spark, near, str(tmp_path))
    assert once.columns == near.columns == cut.columns == docs.columns
    texts = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert (6, "q " * 3 + passage) in texts and any(i == 7 and t.strip() == other for i, t in texts)
    assert (8, f"{passage} é") in texts and (1, "x y z") in texts and (None, passage + " z") in texts
    placed = corpus_pipeline.pack(spark, cut, str(tmp_path))
    assert placed.filter("piece = 0").count() == cut.count()


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark).filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_and_folders():
    assert free_name("spans", ["Spans", "spans_"]) == "spans__" and free_name("x", []) == "x"

    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: Far.conf)

    with pytest.raises(RuntimeError):
        scratch_root(Far)
