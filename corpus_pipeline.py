"""A training corpus from ``documents``: language ID, near-duplicates, repeated passages, benchmark
contamination, mixing.  Each stage takes what its predecessor kept, is written as Parquet to the
shared folder and read again; so a lost executor costs a stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textprep.llm import decontam, langid, minhash_dedup, mixing, substring_dedup
from textprep.llm.common import stored, table

# Language ID, MinHash and mixing depend on models and hashes that SQL doesn't express;
# tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in the text) go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8) the document with the
    smallest id stays."""
    return minhash_dedup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows leave the text, and documents of which nothing is left go."""
    return substring_dedup.strip_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the target weights of the sources ask for."""
    return mixing.emit(docs)


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
