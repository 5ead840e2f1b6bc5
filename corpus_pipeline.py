"""A corpus pipeline of five stages over ``documents``: language ID, quality rules, MinHash near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

Null, empty and blank texts go in the first stage.  Rows that repeat, rows that share a doc_id but not their text, and rows without
doc_id are each judged by their own text; near-dedup keeps all rows of a doc_id it keeps.  Texts of any length are read whole, columns
that a stage does not know are carried, and an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import languages
from tidemark.llm.common import stored, work_dir
from tidemark.llm.minhash import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import keep_quality
from tidemark.llm.substrings import without_repeats

#: No stage can be written in SQL; ``tests/llm/test_pipeline.py`` holds run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; those rejected, without text or without a letter go."""
    return languages.keep_known(docs, languages.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the compression band of their length."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each class of copies and near copies."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat an earlier document's 50-word window; ``n_chars`` follows the text."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
