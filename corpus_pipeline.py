"""The corpus pipeline: language ID, line dedup, near-dedup and packing, each over all that the stage before kept.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of ``documents``; run() writes each
result to the shared folder and gives it to the next stage, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm import op2_best_fit_packing, op3_simhash_neardup, op6_line_dedup, op10_language_id
from lorelog.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the parse can't tell go: those without a letter, and those in none of the labelled languages.

    A document without a label gets the language found; nothing else changes.
    """
    return op10_language_id.keep_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in the largest id only; n_chars follows the text."""
    kept = op6_line_dedup.dedup_lines(docs)
    n_lines, n_dropped = kept.columns[-2:]
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop(n_lines, n_dropped)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles, and of each group of equals."""
    return op3_simhash_neardup.one_of_each(docs, k=5, similarity=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 1024 tokens, with its sequence and its place there."""
    return op2_best_fit_packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("packing", packing)]

#: Three of the stages have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
