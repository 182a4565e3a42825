"""From raw documents to token files: five stages, each written as Parquet and read again by the next.

Rejected texts, near copies and documents with benchmark passages go; the rest is mixed to target shares and written as
token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanframe.llm import decontaminate, language, mixing, near_dup, token_files
from gleanframe.llm.common import cut, table
from gleanframe.llm.queries import MIX, domain_labels, tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like none of the languages learned from the documents themselves, go."""
    return language.recognised(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, a similarity of 0.8) the smallest doc_id stays."""
    return near_dup.deduplicated(docs, words=5, threshold=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, so that their token shares by domain are those of MIX."""
    return mixing.mixed(docs, domain_labels(table(spark, sf_dir, "labels")), MIX)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; the result is what they say of each document."""
    return token_files.token_files(docs, tokenizer(), end_id=2)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Language filters, sketches, rates and Huffman files have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
