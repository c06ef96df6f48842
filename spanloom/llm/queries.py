"""The registered queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import (
    bpe,
    collocations,
    decontamination,
    language_id,
    minhash,
    neighbours,
    ngram_score,
    periodic_runs,
    source_mix,
    substring_dedup,
    token_count,
    token_output,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.word_digests(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hit_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_report(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdict_report(_table(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_score.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_report(_table(spark, sf_dir, "embeddings"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_minhash": op3_minhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_lm_score": op8_lm_score,
    "op9_token_output": op9_token_output,
    "op10_neighbours": op10_neighbours,
    "op11_source_mix": op11_source_mix,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

#: SQL of the queries that SQL can express on whole tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {}
