"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelscope.llm.scratch import parked
from labelscope.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood threshold go."""
    from labelscope.llm.quality_rules import filter_documents
    return filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    from labelscope.llm.near_dups import filter_documents
    return filter_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    from labelscope.llm.decontam import SHORT, filter_documents
    return filter_documents(docs, read_table(spark, sf_dir, "benchmark"), **SHORT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents left out go, repeated ones stay as often as they are taken."""
    from labelscope.llm.mixing import mix_documents
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in the coded token files, in ascending id order; the digest read back from them."""
    import public_tokenizers
    from labelscope.llm.token_output import tokenized
    return tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_dups", near_dups), ("decontaminate", decontaminate),
          ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = parked(stage(spark, docs, sf_dir), name)
    return docs
