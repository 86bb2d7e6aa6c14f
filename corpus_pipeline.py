"""Cleaning, mixing and packing a document corpus in five stages.

Each stage reads what its predecessor wrote. All but the last return the
columns of their input, so the stages can be run one by one.

Every stage takes nulls, empty texts, ties, repeated rows, empty tables and
further columns as its operator says in its module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import exact_dedup, language_id, mixing, ngram_join, packing
from seriesloom.llm.shared import discard, documents, store

LEAST_SCORE = 0.5


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: neither null or without letters, nor undecided."""
    model = language_id.train(docs)
    found = language_id.predict(docs, model, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more on five-word shingles join."""
    return ngram_join.keep_one(docs, width=5, most=(80, 100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents may repeat or go."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language ID", with_language), ("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies), ("source mixing", mixed), ("best-fit packing", packed)]

#: SQL has neither the language model nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
