"""A training corpus from raw documents: five stages, each written and read again.

The ids that a stage drops are written before its texts are read again to be joined with them, so
that Python workers and the shuffle of the texts do not take an executor's memory at once.

Rows whose id is null pass through the stages that name documents by id (near duplicates)
and are named by a hash of their text where a decision must reach them (decontamination).
Rows that repeat an id are one document: it goes only if all its rows were judged to go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, latent, minmax, quality
from tidemark.llm.queries import token_digests, tokenizer_path
from tidemark.llm.staging import Stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS, SIMILARITY = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents written in some language; learned from the documents' own labels."""
    found = language.predict(docs.select(COLUMNS), language.learn_from(docs))
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every near-duplicate component."""
    verdicts = minmax.near_duplicates(docs, WORDS, SIMILARITY)
    copies = verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept")
    copies = Stage(spark, "copies").table(copies.select("doc_id"), "ids")
    return docs.select(COLUMNS).join(copies, "doc_id", "left_anti").select(COLUMNS)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark passage was found."""
    key = F.coalesce("doc_id", F.xxhash64("text"))
    named = docs.select(*COLUMNS, key.alias("_key"))
    hits = latent.contaminated(named, table(spark, sf_dir, "benchmark"), doc_id="_key")
    leaks = Stage(spark, "leaks").table(hits.select(F.col("doc_id").alias("_key")).distinct(), "keys")
    return named.join(leaks, "_key", "left_anti").select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(bpe.Codec(spark, tokenizer_path()), docs)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("bpe", token_ids),
]

# Learned prototypes and a decomposition are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage.table(step(spark, docs, sf_dir), str(k))
        if k:
            stage.drop(str(k - 1))
    return docs
