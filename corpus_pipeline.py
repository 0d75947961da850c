"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, substring dedup, best-fit packing.

Every stage works on the rows that the one before has kept, and its decisions take effect; all but
the last return the columns of documents. Rows with a null doc_id pass through the dedup stages, and
without labels of both kinds all documents pass the first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftgraph.llm import exact_dedup, jaccard_join, packing, substring_dedup, toxicity
from heftgraph.llm.common import broadcast_if_small, free_name, settle, small, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of labels scores 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _repeated_ids(docs: DataFrame) -> DataFrame:
    return settle(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "repeated")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays, once."""
    gone = settle(exact_dedup.dedup(docs).filter("not kept").select("doc_id", "keep_id", "text_sha256"), "dropped")
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    held = free_name("digest", docs.columns)
    later = gone.filter("doc_id <> keep_id").select("doc_id", F.unhex("text_sha256").alias(held)).distinct()
    others = docs.withColumn(held, F.unhex(text)).join(small(later, 64), ["doc_id", held], "left_anti").select(docs.columns)
    # rows that repeat both doc_id and text
    repeated = settle(gone.filter("doc_id = keep_id").select("doc_id").distinct(), "repeated")
    if repeated.isEmpty():
        return others
    again = broadcast_if_small(repeated)
    once = others.join(again, "doc_id", "left_semi").select(docs.columns)
    return others.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.withColumn(held, text).dropDuplicates(["doc_id", held]).drop(held))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at similarity 0.8 of five-word shingles the smallest doc_id stays; rows whose doc_id has other rows stay too, since it doesn't tell which."""
    gone = settle(jaccard_join.classes(docs, 5, 80).filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    gone = gone.join(broadcast_if_small(_repeated_ids(docs)), "doc_id", "left_anti")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out."""
    return substring_dedup.cut(docs, settle(substring_dedup.removals(docs), "removals"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: The first stage is a fitted model, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
