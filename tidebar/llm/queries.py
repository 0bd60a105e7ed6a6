"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm import (op01_pu_classifier, op02_host_reputation, op03_perspectives, op04_warc, op05_pivot_index, op06_simhash, op07_packing,
                         op08_bpe_transducer, op09_token_store, op10_quality_rules, op11_merkle_manifest, op12_periodic_runs, op13_guess_cost)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pu_classifier(spark, sf_dir):
    return op01_pu_classifier.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_host_reputation(spark, sf_dir):
    return op02_host_reputation.judge_documents(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_perspectives(spark, sf_dir):
    return op03_perspectives.digest(table(spark, sf_dir, "conversations"))


def op4_warc(spark, sf_dir):
    return op04_warc.page_captures(table(spark, sf_dir, "pages"))


def op5_pivot_index(spark, sf_dir):
    return op05_pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark, sf_dir):
    return op06_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return op07_packing.packed_digest(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_bpe_transducer(spark, sf_dir):
    import public_tokenizers

    return op08_bpe_transducer.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_store(spark, sf_dir):
    return op09_token_store.stored_digest(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_rules(spark, sf_dir):
    return op10_quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    return op11_merkle_manifest.audit_digest(table(spark, sf_dir, "documents"))


def op12_runs(spark, sf_dir):
    return op12_periodic_runs.runs_digest(table(spark, sf_dir, "documents"))


def op13_secrets(spark, sf_dir):
    return op13_guess_cost.secrets_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pu_classifier, op2_host_reputation, op3_perspectives, op4_warc, op5_pivot_index, op6_simhash, op7_packing,
                            op8_bpe_transducer, op9_token_store, op10_rules, op11_merkle, op12_runs, op13_secrets)}

ORACLE: dict[str, str] = {"op2_host_reputation": op02_host_reputation.ORACLE_SQL, "op3_perspectives": op03_perspectives.ORACLE_SQL,
                          "op4_warc": op04_warc.ORACLE_SQL, "op10_rules": op10_quality_rules.ORACLE_SQL, "op11_merkle": op11_merkle_manifest.ORACLE_SQL}
