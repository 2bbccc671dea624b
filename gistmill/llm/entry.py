"""Queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gistmill.llm import binary, bpe, infilling, jaccard, langmodel, licenses, linecrf, lines, merkle, mixing, quality, rankmerge, vectors

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op1(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op7(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.op3(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankmerge.op10(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op11(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.op12(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_quality_rules, op3_token_shards, op4_line_crf, op5_mix_sources, op6_near_vectors, op7_line_dedup, op8_ngram_jaccard, op9_lm_scores, op10_token_counts, op11_license_scan, op12_fill_in_middle, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.sql(), "op7_line_dedup": lines.SQL, "op11_license_scan": licenses.sql(), "op12_fill_in_middle": infilling.SQL, "op13_merkle_manifest": merkle.SQL}
