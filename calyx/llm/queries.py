"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calyx.llm import (
    decontam, embed_dedup, hmm_lm, html_density, langid, licenses, merkle, minhash, mixing, secrets, token_count, toxicity, trie)
from calyx.llm.common import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(read_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(read_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_count.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_html_extraction, op3_language_id, op4_secret_scan, op5_source_mixing, op6_decontamination,
    op7_embedding_near_dedup, op8_token_counts, op9_hmm_scores, op10_toxicity, op11_merkle_manifest, op12_license_scan,
    op13_conversation_trie)}
ORACLE: dict[str, str] = {"op5_source_mixing": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_license_scan": licenses.ORACLE,
                          "op13_conversation_trie": trie.ORACLE}
