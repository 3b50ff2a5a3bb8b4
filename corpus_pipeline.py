"""A training corpus from ``documents``: filter, deduplicate three ways, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwise.llm.common import written
from foldwise.llm.exact_dedup import drop_exact_copies
from foldwise.llm.near_dedup import keep_one_of_each
from foldwise.llm.packing import pack
from foldwise.llm.quality_fm import keep_good
from foldwise.llm.unit_dedup import without_repeated_units

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs.select(*COLUMNS), labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the largest id, of each group of equal texts."""
    return drop_exact_copies(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate component."""
    return keep_one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; stretches of words that an earlier one has already are cut out of their texts."""
    return without_repeated_units(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece of every document."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
                                   ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL cannot express the classifier and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
