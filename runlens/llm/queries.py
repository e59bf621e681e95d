"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    additive_quality,
    crf_language,
    license_join,
    merkle_manifest,
    overlap_resampling,
    perspective_chat,
    pruned_graph,
    robust_outliers,
    simhash_pigeonhole,
    style_tree,
    toxicity_rnn,
    viterbi_pieces,
    water_filling,
)
from runlens.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspective_chat.views(table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_rnn.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.quality(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.identify(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_pieces.encoded(table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water_filling.mixture(table(spark, sf_dir, "documents"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extracted(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pigeonhole.simhash_groups(table(spark, sf_dir, "documents"))


def op11_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat, op2_toxicity, op3_quality, op4_neighbours, op5_language, op6_licenses, op7_pieces, op8_mixture, op9_pages, op10_simhash,
        op11_additive, op12_manifest, op13_resampling,
    )
}
ORACLES = {
    "op1_chat": perspective_chat.ORACLE,
    "op6_licenses": license_join.oracle(),
    "op8_mixture": water_filling.ORACLE,
    "op9_pages": style_tree.ORACLE,
    "op12_manifest": merkle_manifest.ORACLE,
    "op13_resampling": overlap_resampling.ORACLE,
}
