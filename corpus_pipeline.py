"""A training corpus from ``documents``: quality, near-duplicates, repeats, leaks, packing.

Every stage works on all rows that the one before kept, and all but the last keep their columns,
whatever their names.  Nulls: a row without a text is scored as an empty one; one without a
doc_id is kept or dropped by its text alone.  Repeated rows leave the second stage as one.  An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenspark.llm import classifiers, decontaminate, neardup, packing, substring
from screenspark.llm.common import checkpoint, fold, table
from screenspark.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifiers.good_only(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeated_words(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("packing", packed),
]

#: No stage but the last can be told in SQL, so tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is cut off from its lineage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
