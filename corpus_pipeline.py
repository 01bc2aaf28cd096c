"""A corpus from raw documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, langid, pieces, pii, simhash
from loomgraph.llm.shared import scratch, ship

#: The stages can't be said in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from docs' own labelled rows.

    Null, empty and letterless texts go, as does text that no language explains; repeated
    rows stay or go together; an empty table gives none.
    """
    ship(spark)
    return langid.keep_identified(docs, langid.training(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, and of rows that share it one of each text's fingerprint.

    Null and empty texts are one group. Rows without a doc_id can't be named and stay. An
    empty table gives none.
    """
    ship(spark)
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item's passage.

    Null and empty texts hold none and stay; repeated rows stay or go together; without
    items all stay.
    """
    ship(spark)
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, n_chars counted anew; no row goes, and null texts stay null."""
    ship(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the texts: doc_id, n_tokens, token_ids, round_trip of every row; of null and empty texts none."""
    ship(spark)
    return pieces.encode(docs, pieces.model_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
