"""The registered queries of this folder: each runs its operator over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark_decontamination, best_fit_packing, document_fingerprints, license_scans, line_dedup, ngram_jaccard_join, quality_classifier, secret_scans, substring_dedup, token_counts
from ._shared import table

#: Tokens of a training sequence, and the vocabulary that counts them.
SEQUENCE_TOKENS = 2048
VOCABULARY = "word_bpe_49k.json"
#: Sites that must hold a line before it counts as boilerplate.
MIN_SITES = 10
#: Score from which a document counts as good.
KEPT_SCORE = 0.7


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), SEQUENCE_TOKENS)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scans.digest(license_scans.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEPT_SCORE).cast("int").alias("predicted"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return benchmark_decontamination.contaminated(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    found = line_dedup.without_boilerplate(table(spark, sf_dir, "documents").withColumn("n_lines", lines), MIN_SITES)
    return found.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed_lines"), "text")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(secret_scans.scan(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), SEQUENCE_TOKENS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.repeats(docs).unionByName(substring_dedup.passages(docs)).drop("text_hash")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
ORACLES = {
    "op2_license_scans": license_scans.ORACLE, "op4_ngram_jaccard_join": ngram_jaccard_join.ORACLE, "op5_benchmark_decontamination": benchmark_decontamination.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE.format(min_sites=MIN_SITES), "op8_secret_scans": secret_scans.ORACLE,
}
