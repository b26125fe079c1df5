"""From documents to packed training sequences: language, near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsequilt.llm import langid, packing, pii, simhash
from pulsequilt.llm.common import stored_alone, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, with all their columns. A null text is empty, and an empty one goes; equal rows stay or go together."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (by op2's links) stays: that of the least doc_id. Null texts count as empty; of equal rows one stays, and a null doc_id only where its group has no other."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated rows and null ids too; personal data in their texts gives way to its kind. A null text stays null."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences: a null text is its end mark alone, repeated rows are packed each. Workers still hold what earlier stages loaded, so they remember fewer words."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=60_000)


STAGES = [("language", known_language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing_stage)]

#: Neither the text model nor Golay codes nor the random field can be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each reads what the one before stored, and what a stage stored on its way goes when it is done."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = stored_alone(lambda: stage(spark, docs, sf_dir))  # noqa: B023 - called at once
    return last(spark, docs, sf_dir)
