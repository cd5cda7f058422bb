"""Stages of the corpus pipeline; each takes the documents that the one before has kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of documents. Null and empty texts go in the first
stage (they have no language); rows that repeat an id are one document for the
near-duplicate stage. An empty table passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, jaccard, langid, mixing, toxicity
from quire.llm.common import Stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters know; those without letters or in unknown languages go."""
    return langid.keep_known(docs, langid.train(langid.train_rows(table(spark, sf_dir, "documents"))))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages."""
    model = toxicity.train(table(spark, sf_dir, "documents"), toxicity.train_labels(table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each drawn copy, with its shard and its order in the shard."""
    return mixing.mixed(docs)


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has kept is stored until the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        kept = Stored(stage(spark, docs, sf_dir))
        if before:
            before.remove()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages' models and hashes can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None
