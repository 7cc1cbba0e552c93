"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data gets pseudonyms, sources are mixed to target weights, and what is taken is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.mixing import mixed_documents
from larkspur.llm.ngram_join import without_near_duplicates
from larkspur.llm.packing import pack, with_digest
from larkspur.llm.pseudonyms import pseudonymise_documents
from larkspur.llm.shared import Table, read_table
from larkspur.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on `labels`, does not call toxic."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group."""
    return without_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal values."""
    return pseudonymise_documents(docs, spans=None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return with_digest(pack(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the first stage; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again as the next one's input."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = Table(stage(spark, docs, sf_dir), name)
        if last:
            last.drop()
        docs, last = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
