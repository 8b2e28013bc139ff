"""The corpus pipeline: documents go through STAGES, each written as Parquet and read again for the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Null and empty texts pass through every stage as documents without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import benchmark_decontamination, best_fit_packing, line_dedup, ngram_jaccard_join, quality_classifier
from meridian.llm._shared import cut, table
from meridian.llm.queries import MIN_SITES, SEQUENCE_TOKENS, vocabulary_path

#: Score below which a document is rejected, and benchmark items from which on it counts as leaked.
REJECTED_BELOW, LEAKED_ITEMS = 0.5, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = quality_classifier.score(docs, table(spark, sf_dir, "labels"), docs.columns, score_col="_score")
    return scored.where(F.col("_score") >= REJECTED_BELOW).drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, each but for its first holder; n_chars follows the text."""
    cleaned = line_dedup.without_boilerplate(docs, MIN_SITES, removed_col="_removed").drop("_removed")
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Documents are known by id and text, so
    another text of the same id stays; and of rows that are equal in both one stays."""
    return ngram_jaccard_join.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    found = benchmark_decontamination.find(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns, prefix="_found_")
    return found.where(F.size("_found_items") < LEAKED_ITEMS).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokens of what is left, in sequences of SEQUENCE_TOKENS."""
    return best_fit_packing.pack(docs, vocabulary_path(), SEQUENCE_TOKENS)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: No SQL: the stages train a model, intersect shingles, run a tokenizer and pack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
