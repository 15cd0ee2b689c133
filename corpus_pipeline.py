"""Cleaning pipeline over documents: toxicity, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All stages but the last keep the columns of documents, whatever they are called; texts that a stage shortens get a new
n_chars where there is such a column. The last stage returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

Rows: each stage follows its operator; a null text is an empty one and stays, a null doc_id is an id of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelens.llm import bpe, decontaminate, lines, simhash, toxicity
from votelens.llm.common import table, written
from votelens.llm.registry import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted to the labelled documents that may be learnt from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.trainable())
    return toxicity.scored(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold, too."""
    out = lines.dedup_lines(docs)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark."""
    return decontaminate.marked(docs, table(spark, sf_dir, "benchmark")).filter(~decontaminate.contaminated()).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's tokens and of what they decode to."""
    return bpe.op9_bpe(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies),
          ("benchmark_decontamination", drop_contaminated), ("byte_bpe", tokenise)]

#: The stages' classifier, fingerprints and tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over what its predecessor has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
