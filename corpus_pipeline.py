"""The corpus pipeline: quality rules, exact dedup, near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
documents. Near-duplicates are five-word shingles at a similarity of 0.8 or more. Stages stand for themselves: run() writes the result
of each to the shared folder and reads it again as the next one's input.

Rows, in every stage: null and empty texts fail the quality rules and go there; alone, the other stages keep them (exact_dedup keeps
one of all empty texts), and best_fit_packing gives them a piece of no words. Null ids, languages and sources are no reason to drop a
row. Very long texts are read whole and end as many pieces. Of equal texts the smallest id stays, of rows that repeat id and text one
stays; of near-duplicates the smallest id stays. A score at the threshold passes. Extra columns pass through all stages but the last,
whatever their names. An empty table gives an empty result; without labels the base rules alone decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import exact, minhash, packing, quality, substring
from caselens.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return minhash.near_dedup(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; n_chars follows the text."""
    out = substring.remove_repeats(docs, window=35)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its bin."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The log ratios, the components and the packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
