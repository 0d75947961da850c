"""Queries of this subpackage for __spark_entry__.py: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heftgraph.llm import byte_bpe, exact_dedup, html_text, jaccard_join, maxscore, minhash_forest, orc_ids, packing, resampling, substring_dedup, token_counts, toxicity, whitening
from heftgraph.llm.common import scratch_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5).drop("query_row")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), 3, 90)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), prefer_largest=True)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orc-ids")
    orc_ids.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return orc_ids.digests(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 4)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, buckets=10_000, seed=7, least_words=20)


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.classes(table(spark, sf_dir, "documents"), 2, 80)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _near_sql(k: int, percent: int, more: str = "") -> str:
    """Classes of documents whose sets of k-word shingles are similar, from all pairs that share a shingle."""
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE [array_to_string(list_slice(w, i, i + {k - 1}), ' ') FOR i IN range(1, len(w) - {k - 2})] END)) AS s FROM w),
        r AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
        t AS (SELECT rep, n, unnest(s) AS x FROM r),
        p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * c >= {percent} * (na + nb - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c AS (SELECT rep AS a, rep AS b FROM r UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
        m AS (SELECT a, min(b) AS m FROM c GROUP BY 1)
        SELECT s.doc_id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m, s.doc_id) AS component_id{more} FROM s LEFT JOIN r ON s.s = r.s LEFT JOIN m ON m.a = r.rep"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_maxscore": op2_maxscore,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_orc_ids": op9_orc_ids,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_minhash_forest": op13_minhash_forest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_maxscore": """
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op5_ngram_jaccard_join": _near_sql(3, 90),
    "op13_minhash_forest": _near_sql(2, 80, ", coalesce(m, s.doc_id) = s.doc_id AS kept"),
    "op12_resampling": """
        WITH RECURSIVE bit AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
        tab AS (SELECT list(c ORDER BY b) AS t FROM bit WHERE k = 8),
        w AS (SELECT doc_id, false AS target, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
        x AS (SELECT row_number() OVER () AS i, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), '@UP@', '@LOW@'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM w),
        f AS (SELECT i, target, unnest(list_concat(w, [w[j] || ' ' || w[j + 1] FOR j IN range(1, len(w))])) AS f FROM x),
        u AS (SELECT f, hex(encode(f)) AS h FROM f GROUP BY 1),
        k AS (SELECT f, xor(list_reduce([CAST('0x' || substr(h, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT) FOR j IN range(len(h) // 2)], lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b FROM u, tab),
        n AS (SELECT i, target, b, count(*) AS n FROM f JOIN k ON f.f = k.f GROUP BY 1, 2, 3),
        c AS (SELECT b, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM n GROUP BY 1),
        a AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
        g AS (SELECT b, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * CAST(a.s + 10000 AS DOUBLE) / (CAST(c.s + 1 AS DOUBLE) * CAST(a.t + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM c, a),
        q AS (SELECT i, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS v FROM n JOIN g ON n.b = g.b WHERE NOT target GROUP BY 1),
        d AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(v // n - CASE WHEN v % n < 0 THEN 1 ELSE 0 END, 0) AS weight, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM x LEFT JOIN q ON x.i = q.i WHERE NOT target),
        z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (words >= 20) OVER () AS m FROM z)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN words >= 20 AND r <= 25 * m // 100 THEN r END AS rank FROM o""".replace("@UP@", _UPPER).replace("@LOW@", _UPPER.lower()),
}
