"""Registered queries: each operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from votelens.llm import balltree, bpe, decontaminate, divergence, lexical, lines, pii, ppm, pstable, repeats, secrets, simhash, toxicity
from votelens.llm.common import table

#: Vocabulary of the tokenizer.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


SQL["op5_ball_tree"] = balltree.SQL
SQL["op11_source_divergence"] = divergence.SQL
SQL["op12_lexical_search"] = lexical.SQL


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.op1_ppm(table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2_secrets(table(spark, sf_dir, "documents"))


@query
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op3_repeats(table(spark, sf_dir, "documents"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4_simhash(table(spark, sf_dir, "documents"))


@query
def op5_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.op5_search(table(spark, sf_dir, "embeddings"))


@query
def op6_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6_pii(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op7_lines(table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op9_bpe(table(spark, sf_dir, "documents"), bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op11_divergence(table(spark, sf_dir, "documents"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.op12_lexical(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_pstable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.op13_search(table(spark, sf_dir, "embeddings"))
