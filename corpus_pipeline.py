"""A corpus pipeline: classify, filter by rules, drop near duplicates, mix the sources, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. No stage can be said in SQL as a whole (a learned model, robust
estimates, local search), so that there is no SQL twin; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import mixing, ngram_join, packing, quality_model, quality_rules
from tapeloom.llm.base import stored, table
from tapeloom.llm.q_documents import tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.keep_quality(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality_rules.keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one whose id names the group, or one without an id where none has any."""
    return ngram_join.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, each document as often as drawn."""
    return mixing.replicate(docs).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
