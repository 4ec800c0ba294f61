"""A corpus pipeline of five stages over ``documents``: good texts, one of each near copy, no benchmark
items, personal data masked, packed into sequences.

Every stage takes all rows that the one before kept.  All but the last return the columns of ``documents``.
Nulls, empty texts, repeated rows and empty tables are handled as the operators say: null and empty texts
are judged by the classifier like others, are never copies, leak nothing and hold no personal data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wideloom.llm import catalog, decontaminate, ngram_join, packing, pii, quality
from wideloom.llm.common import free, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on a bounded sample of labelled ones, rejects."""
    return quality.keep_good(docs, quality.train(docs, catalog.read(spark, sf_dir, "labels")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of documents with 80 % of their 5-word shingles in common."""
    return ngram_join.drop_near_copies(docs, k=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    return decontaminate.drop_leaks(docs, catalog.read(spark, sf_dir, "benchmark"))


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by marks."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in pieces of binary length, one per sequence; the encoder's memory ends with its task."""
    return packing.pack(docs, catalog.tokenizer_path(), keep_units=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("PII", private_stage),
    ("packing", packing_stage),
]

# Trained classifiers and a tokenizer decide, which SQL cannot express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stored in the shared folder before the next and freed after it."""
    docs, last = catalog.read(spark, sf_dir, "documents"), len(STAGES) - 1
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < last:
            docs = stored(docs, "stage")
            if i:
                free(before)
    return docs
