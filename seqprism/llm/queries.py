"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, bpe, gru_language, hilbert, merkle, multi_index, nn_descent, packing, risk_rules, rule_ensemble, segment_toxicity, suffix_dedup, whitening
from .common import read


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(read(spark, sf_dir, "documents"), 24, ["lang", "source"])


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_sparse_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_bidirectional_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_language.identify(read(spark, sf_dir, "documents"))


def op8_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents")).drop("node")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passage_digests(read(spark, sf_dir, "documents"))


def op10_maximal_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_two_pass_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digests(read(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(read(spark, sf_dir, "documents"))


def op13_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_rows(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_inverted_multi_index": op4_inverted_multi_index,
    "op5_risk_controlled_rules": op5_risk_controlled_rules,
    "op6_sparse_rule_ensemble": op6_sparse_rule_ensemble,
    "op7_bidirectional_gru_language": op7_bidirectional_gru_language,
    "op8_bagminhash_near_dedup": op8_bagminhash_near_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_maximal_segment_toxicity": op10_maximal_segment_toxicity,
    "op11_two_pass_whitening": op11_two_pass_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nn_descent_search": op13_nn_descent_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_hilbert_sharding": hilbert.oracle_sql(24, ["lang", "source"]),
    "op5_risk_controlled_rules": risk_rules.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
}
