"""Raw message store, partitioned by label and written before anything is parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.operators.keyed import keep_first
from peneira.sources.registry import active_sources


BODIES = ("raw_text", "raw_html")


def append_raw(messages: DataFrame, path: str) -> None:
    """Append messages unchanged.

    Rows are rebalanced by label: small labels share tasks and files, and a label holding
    much of the mail is split over several.
    """
    messages.hint("rebalance", "label").write.mode("append").partitionBy("label").parquet(path)


def read_messages(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Messages of active configured labels. Other labels' folders are never opened."""
    stored = spark.read.parquet(path)
    wanted = active_sources(sources).select("label").distinct()
    return stored.join(wanted, "label", "left_semi")


def write_batch(messages: DataFrame, path: str, batch: str) -> None:
    """Write one sync batch unchanged, under its labels' folders, in place of an earlier try of it."""
    (
        messages.withColumn("batch", F.lit(batch)).hint("rebalance", "label")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "batch").parquet(path)
    )


def first_arrivals(messages: DataFrame, order: str = "received_at") -> DataFrame:
    """Each id once: its earliest arrival; equal times go by the other columns, bodies last."""
    ties = [c for c, t in messages.dtypes if c not in ("message_id", order, *BODIES) and not t.startswith("map")]
    bodies = F.md5(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in BODIES if c in messages.columns]))
    ranked = messages.withColumn("_bodies", bodies)
    return keep_first(ranked, ["message_id"], [F.col(order), *map(F.col, ties), F.col("_bodies")]).drop("_bodies")


def drop_seen(new: DataFrame, stored: DataFrame, order: str = "received_at") -> DataFrame:
    """Messages whose id is not stored yet, each id once (the earliest arrival).

    Only the id column of the store is read. For a store that is asked again and again,
    ``known_ids.KnownIds.unseen`` does the same without moving its ids.
    """
    return first_arrivals(new.join(stored.select("message_id"), "message_id", "left_anti"), order)


def message_status(messages: DataFrame, jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Processing status and error per message: new, parsed, incomplete or failed."""
    outcome = jobs.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.size("missing_fields") > 0).alias("n_incomplete"),
    )
    failed = failures.groupBy("message_id").agg(F.min("error").alias("failure"))
    return (
        messages.select("message_id", "label", "received_at")
        .join(outcome, "message_id", "left")
        .join(failed, "message_id", "left")
        .select(
            "message_id",
            "label",
            "received_at",
            F.coalesce("n_jobs", F.lit(0)).cast("long").alias("n_jobs"),
            F.when(F.col("failure").isNotNull(), "failed")
            .when(F.col("n_incomplete") > 0, "incomplete")
            .when(F.col("n_jobs") > 0, "parsed")
            .otherwise("new")
            .alias("status"),
            F.col("failure").alias("error"),
        )
    )


def sync_summary(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Last arrival and message counts per source; sources without mail stay, with zeros."""
    per_label = messages.groupBy("label").agg(
        F.max("received_at").alias("last_sync_at"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "new").alias("n_new"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )
    zero = F.lit(0).cast("long")
    return (
        sources.select("label", F.col("status").alias("source_status"))
        .join(per_label, "label", "left")
        .select(
            "label",
            "source_status",
            "last_sync_at",
            F.coalesce("n", zero).alias("n_messages"),
            F.coalesce("n_new", zero).alias("n_new"),
            F.coalesce("n_failed", zero).alias("n_failed"),
        )
    )
