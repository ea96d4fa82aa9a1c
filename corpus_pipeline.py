"""Training-text pipeline over ``documents``: each stage reads what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parityspark.lineage import cut
from parityspark.llm import op2_language_id, op5_byte_bpe, op6_quality_rules, op7_ngram_jaccard, op9_decontamination


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return op6_quality_rules.keep(docs, op6_quality_rules.learn(op6_quality_rules.metrics(docs)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like a language the corpus names, by a model and floors learned from the documents that name one."""
    return op2_language_id.keep(docs, op2_language_id.with_floors(docs, op2_language_id.train(docs)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return op7_ngram_jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return op9_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests that prove the way back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op5_byte_bpe.digests(op5_byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The last stage's token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
