"""Cleans a corpus in five stages, each written to shared storage and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontaminate, merge_dropout, pii, simhash, toxicity
from attesta.llm.store import kept
from attesta.session import table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low expected severity, by a model of the labelled ones among `docs`. Null texts count as empty."""
    return toxicity.civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near texts (five-word shingles, similarity 0.8), that of the smallest id.

    Null texts and texts without words are near each other; of rows that repeat an id one stays, rows without one all.
    """
    return simhash.one_each(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none; rows without an id stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind. Null texts stay null."""
    return pii.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document with merge-dropout, and whether they decode to its text. Null texts have none."""
    return merge_dropout.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", civil), ("near_copies", distinct), ("decontamination", untested), ("personal_data", private), ("pieces", pieces)]

# SQL can express neither the fitted model nor the segmentation; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
