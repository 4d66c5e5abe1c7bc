"""From documents to token ids: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each stage's rows to the shared folder and reads them again.
A null or empty text has no letters, and so goes at the language stage at the latest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorlake.llm import byte_bpe, decontam, langid, ngram_join, quality_gam, queries
from rotorlake.llm.common import small_batches, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below one half."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.classify(docs, model, score="__score").where("__score >= 0.5").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language."""
    model = langid.train(docs, queries.PIECES)
    return langid.identify(docs, model, pred="__lang", score="__score").where("__lang <> 'und'").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, once; documents without an id stay.

    Ids that go are joined, not ids that stay: they are few, so that texts seldom shuffle.
    """
    found = ngram_join.near_duplicates(docs).where("doc_id is not null")
    ids = stored(found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "dropped")
    once = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = ids.where("stays").select("doc_id")
    if again.isEmpty():
        return once
    return once.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id")
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document and decodes it again; the ids are kept."""
    coded = byte_bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(coded, queries.RANKS, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [(name, small_batches(stage)) for name, stage in (("quality_classifier", quality), ("language_id", language), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminate), ("byte_bpe", tokens))]

#: The classifier, the language model and components have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
