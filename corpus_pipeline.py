"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next stage's
docs. The first four return the columns of ``docs``: what they drop is gone for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavox.llm.common import stored, table
from stratavox.llm.content_sort import keep_distinct
from stratavox.llm.decontaminate import keep_clean
from stratavox.llm.language import keep_identified
from stratavox.llm.ngram_join import keep_one_of_each
from stratavox.llm.packing import pack, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and texts without a letter go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space the longest, then the one with the smallest id."""
    return keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts whose five-word shingles link them at a similarity of 0.8, the one with the smallest id."""
    return keep_one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in windows of 2,048 tokens."""
    return pack(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Language identification and packing have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is stored in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
