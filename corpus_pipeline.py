"""Documents to packed sequences: toxic ones go, poor ones go, one of each group stays, the rest is packed.

All stages but the last return the columns of `documents`, whatever further columns come in, and rows as
they were. An empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import packing, quality_crf, simhash_dedup, toxicity
from tickloom.llm.common import DOCUMENT_COLUMNS, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not predicted toxic, each judged by itself; NULL and empty texts are not toxic."""
    return toxicity.clean_documents(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are content by half of their words at least; NULL and empty texts have too few words."""
    return quality_crf.good_documents(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: the smallest doc_id, one of equal rows; rows without a doc_id stay."""
    return simhash_dedup.one_of_each(docs.select(*DOCUMENT_COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document with its place in a sequence; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("packing", pack)]

#: The models and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`; what a stage returns is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
