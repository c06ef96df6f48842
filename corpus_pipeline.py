"""From raw documents to token ids, in five stages; each works on all rows that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet and read again
as the next one's ``docs``. All but the last keep the columns of ``documents``. Every row is judged by
its own text, also rows that share an id or are equal; rows without id are neither duplicates nor cut nor
contaminated and stay, unless their language is unclear. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontamination, language_id, minhash, substring_dedup
from spanloom.session import staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null texts and texts without a letter have none and go."""
    return language_id.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; texts without words are nobody's duplicate."""
    return minhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long word sequences that one with a smaller id holds too; some texts end empty."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages hold less than a twentieth of the words; empty texts are clean."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to, a row for every row; null texts count as empty."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Compression, MinHash and BPE are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
