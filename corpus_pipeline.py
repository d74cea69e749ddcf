"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that becomes the next one's docs. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqprism.llm import bagminhash, packing, risk_rules, rule_ensemble, suffix_dedup
from seqprism.llm.common import read, stored
from seqprism.session import prepare

#: The stages give no rows that SQL could compute: they learn, hash and sort suffixes.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a risk-controlled cutoff of their language.

    Null and empty texts have no words and go; rows with a null id or language are judged like others;
    repeated rows share their fate; an empty table stays empty.
    """
    return risk_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the sparse rule ensemble scores below 0.5, null and empty texts by the same
    model; repeated rows share their fate; an empty table stays empty."""
    return rule_ensemble.keep_good(docs, read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates.

    Rows without a word (null and empty texts) or without an id stay as they are; of repeated rows one
    stays; an empty table stays empty.
    """
    prepare(spark)
    return bagminhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller id has, too. Null texts stay
    null, shorter ones whole; repeated rows of one id aren't each other's smaller ids; an empty table
    stays empty."""
    prepare(spark)
    return suffix_dedup.without_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of 2048 tokens: one row per piece. Null texts count as empty (one
    token), repeated rows as documents of their own; an empty table gives no pieces."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder before the next stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
