"""Corpus pipeline: quality, exact copies, near copies, test items, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peneira.llm import decontaminate, exact_dedup, packing, quality, simhash
from peneira.llm.common import table
from peneira.session import apply_settings, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``docs``, doesn't reject."""
    return quality.keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its place in a packed sequence."""
    return packing.pack(docs)


Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_settings(step: Step) -> Step:
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return step(apply_settings(spark), docs, sf_dir)

    return run_step


STAGES: list[tuple[str, Step]] = [
    ("quality", _with_settings(quality_stage)),
    ("exact_dedup", _with_settings(exact_dedup_stage)),
    ("simhash", _with_settings(simhash_stage)),
    ("decontamination", _with_settings(decontamination_stage)),
    ("packing", _with_settings(packing_stage)),
]

# Token ids can't be expressed in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
