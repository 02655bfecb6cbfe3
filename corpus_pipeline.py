"""The corpus pipeline: language ID, near-dedup, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a DataFrame, which ``run`` writes as Parquet and reads again for the next one. All
but the last return the columns of ``documents``:

* ``language_id`` drops texts without a language (operator 3);
* ``near_dedup`` keeps one text of each group of near copies, by shingles of five words at a similarity
  of 0.8 or more (operator 1);
* ``decontaminate`` drops texts that leak an item of ``benchmark`` (operator 6);
* ``redact_secrets`` replaces secrets inside the texts and keeps every row (operator 4);
* ``mix_sources`` returns the rows of the mixture, with domain, epoch and n_tokens (operator 5).

Null and repeated values are handled as each operator's docstring says; an empty table passes all
stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calyx.llm import decontam, langid, minhash, mixing, secrets
from calyx.llm.common import read_table, small_batches, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.drop_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("redact_secrets", redact_secrets), ("mix_sources", mix_sources)]

#: Language profiles, hashed shingles and edit distances have no SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
