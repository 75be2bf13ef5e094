"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sirenfield.llm import lines, mixing, packing, quality, simhash
from sirenfield.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the corpus counts come from ``docs``, the trusted ids from ``labels``."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 3 lines or 50 words go, and documents that lose all their words to it."""
    return lines.without_later_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by fingerprints of 4-word shingles within 4 bits one stays."""
    return simhash.drop_near(docs, k=4, t=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing),
]
#: hashed n-grams and SimHash have no SQL form; tests hold the run against plain re-statements
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
