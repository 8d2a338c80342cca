"""Source registry: which labels may be read, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.operators.keyed import upsert_latest


def active_sources(sources: DataFrame) -> DataFrame:
    # A comparison, not a bare boolean: dynamic partition pruning needs a selective predicate.
    return sources.where(F.col("status") == "active")


def save_sources(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Add, edit, activate or deactivate sources; a new label is one more row."""
    return upsert_latest(stored, changes, ["label"], "updated_at")


def check_labels(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve each source's label to its id; report missing and nested labels."""
    parts = F.split("label", "/")
    return (
        sources.drop("label_id")
        .join(catalog.withColumnRenamed("label_path", "label"), "label", "left")
        .select(
            "source_id",
            "label",
            "label_id",
            F.when(F.col("label_id").isNull(), "missing").otherwise("found").alias("label_status"),
            F.when(
                F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
            ).alias("parent_label"),
            F.size(parts).alias("depth"),
        )
    )


def record_sync(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry with ``last_sync_at`` from the table of sync runs: the latest run, whether or not it brought mail."""
    last = runs.groupBy("label").agg(F.max("synced_at").alias("_synced_at"))
    known = F.col("last_sync_at") if "last_sync_at" in sources.columns else F.lit(None).cast("timestamp")
    return sources.join(last, "label", "left").withColumn("last_sync_at", F.greatest(known, "_synced_at")).drop("_synced_at")
