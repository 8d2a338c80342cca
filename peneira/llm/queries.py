"""One query per corpus operator over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peneira.llm import (
    conversations, decontaminate, exact_dedup, frames, packing, periodic, pii, quality, secrets, sharding, simhash, token_counts, topk,
)
from peneira.llm.common import table
from peneira.session import scratch_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of all documents with its suffix sums."""
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item, with the best alignment of each."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to frame files and report what reading them back gives."""
    path = scratch_path(spark, "frame-files")
    frames.write_frames(table(spark, sf_dir, "documents"), path)
    return frames.document_table(spark, path)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a ledger of blobs."""
    return secrets.document_secrets(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.document_pii(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a packed sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    return conversations.repair_report(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after planted ones."""
    return periodic.document_runs(table(spark, sf_dir, "documents"))


def op13_topk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector, by inner product."""
    return topk.nearest(table(spark, sf_dir, "embeddings"), 10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontaminate, op3_simhash, op4_token_frames, op5_exact_dedup,
        op6_hilbert_shards, op7_secret_scan, op8_pii, op9_quality, op10_packing,
        op11_conversation_repair, op12_periodic_runs, op13_topk_join,
    )
}

ORACLE = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_secret_scan": secrets.ORACLE,
}
