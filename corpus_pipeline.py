"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the rows its predecessor kept, written as Parquet and read
again, and returns the columns of ``documents``; the last returns the packed
pieces.  Benchmark and labels come from the tables beside the documents.

Defined cases: stages decide row by row.  A repeated row (id and text) passes
the second stage once, of equal or near texts one stays, and another text of
the same id is judged on its own.  Rows with a null id, and null or empty
texts or ones without words, are copies of nothing but their own repetition
and leak nothing but what their text holds.  Without labels every document is
kept by the first stage; without a benchmark the third drops none; very long
texts go through whole; empty tables give no rows.  Other columns are handed
on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accesslens.llm import decontaminate, near_dup, packing, quality
from accesslens.llm.queries import CAPACITY, END_ID, VOCABULARY
from accesslens.llm.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dup.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces, packed into sequences."""
    return packing.packed_digests(docs, VOCABULARY, CAPACITY, END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer are beyond SQL; see the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
