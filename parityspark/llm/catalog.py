"""Queries of the operators in this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import op1_toxicity, op2_language_id, op3_quality_classifier, op4_sharding, op5_byte_bpe, op6_quality_rules, op7_ngram_jaccard, op8_quotation_linking, op9_decontamination, op10_url_filter, op11_exact_dedup, op12_structure_repair, op13_merkle_manifest
from .common import remainder
from .oracles import ORACLES

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(folds: int, fold: int):
    return F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1_toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = op2_language_id.train(docs.filter(op2_language_id.learned(F.col("doc_id"))))
    return op2_language_id.predict(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_quality_classifier.classify_in_context(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", F.round("perplexity", 6).alias("perplexity"), F.round("fence", 6).alias("fence"), "kept")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op4_sharding.assign(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = op5_byte_bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return op5_byte_bpe.digests(coded)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = cut(op6_quality_rules.metrics(read(spark, sf_dir, "documents")), "metrics")
    judged = op6_quality_rules.judge(counted, op6_quality_rules.learn(counted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 9).alias("quality"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_ngram_jaccard.join(read(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quotation_linking.link(read(spark, sf_dir, "conversations"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontamination.digests(op9_decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op11_exact_dedup.dedup(read(spark, sf_dir, "documents"), all_digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_structure_repair.repair(op12_structure_repair.damage(read(spark, sf_dir, "conversations")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(remainder(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1)
    found = op13_merkle_manifest.manifest(read(spark, sf_dir, "documents"), changed)
    digests = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return found.select("doc_id", *digests, "proof_sha256", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1,
    "op2_language_id": op2,
    "op3_quality_classifier": op3,
    "op4_sharding": op4,
    "op5_byte_bpe": op5,
    "op6_quality_rules": op6,
    "op7_ngram_jaccard": op7,
    "op8_quotation_linking": op8,
    "op9_decontamination": op9,
    "op10_url_filter": op10,
    "op11_exact_dedup": op11,
    "op12_structure_repair": op12,
    "op13_merkle_manifest": op13,
}


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
