"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and is
written as Parquet and reread as the next one's documents.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import crf_language, simhash_pigeonhole, toxicity_rnn, viterbi_pieces, water_filling
from runlens.llm.common import materialise, table, unused


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go.  A text in several languages stays however its words are
    shared among them, and so does every text with a letter if no language was learned."""
    model = crf_language.fit(docs, ~crf_language.held_out(F.col("doc_id")))
    if not model.langs:
        return docs.filter(crf_language.has_letter("text"))
    (name,) = unused(docs, "__lang")
    got = docs.withColumn(name, crf_language.predictor(model)("text"))
    return got.filter(F.col(name)["lang_pred"] != crf_language.UNKNOWN).drop(name)


def inoffensive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose toxicity score reaches the operator's threshold go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity_rnn.fit(docs.select("doc_id", "text"), labels, ~toxicity_rnn.held_out(F.col("doc_id")))
    (name,) = unused(docs, "__score")
    got = docs.withColumn(name, toxicity_rnn.scorer(model)("text"))
    return got.filter(F.col(name) < toxicity_rnn.THRESHOLD).drop(name)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash_pigeonhole.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return water_filling.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return viterbi_pieces.encoded(docs)


STAGES = [
    ("language", identified),
    ("toxicity", inoffensive),
    ("near duplicates", distinct),
    ("mixing", mixed),
    ("pieces", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


