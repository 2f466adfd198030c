"""The corpus pipeline: each stage takes the documents its predecessor kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents. ``run`` writes each stage's rows and reads them back as the
next one's documents, so that a lost executor costs one stage's partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.exact_dedup import ExactDedup
from weftline.llm.line_frequency import clean
from weftline.llm.mixing import DOMAINS, Mixture, labelled_domains
from weftline.llm.near_copies import keep_one
from weftline.llm.packing import packed
from weftline.llm.scratch import Scratch, released


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines of any length go, and documents that fail the rules or are depleted."""
    return clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return ExactDedup(docs).keep_first()


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return Mixture(docs, labelled_domains(labels), list(DOMAINS.values()), rows=True).mixed()


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in bins."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fingerprints, the classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with released():  # a stage's own tables go once its rows are written
            docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
