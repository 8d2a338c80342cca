"""Incremental sync: every run takes in what has arrived since the last one."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from peneira.sources.known_ids import KnownIds, open_ids
from peneira.sources.messages import first_arrivals, write_batch
from peneira.sources.registry import active_sources

RUNS = "label string, synced_at timestamp, n_taken long, newest_at timestamp, batch string"


def store_ids(spark: SparkSession, store: str, schema: StructType) -> KnownIds:
    """Id store beside a message store; made from the messages if there are some and no ids yet."""
    ids = open_ids(spark, f"{store.rstrip('/')}.ids")
    if ids.ids().isEmpty():
        try:
            stored = spark.read.schema(schema).parquet(store).select("message_id")
            ids.add(stored, "before")
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    return ids


def sync_stream(
    spark: SparkSession,
    incoming: str,
    store: str,
    checkpoint: str,
    schema: StructType,
    max_files: int = 1000,
    sources: DataFrame | None = None,
    runs: str | None = None,
    run_at: dt.datetime | None = None,
) -> int:
    """Take new files of ``incoming`` into ``store``, each message id once, then stop; returns how many were taken.

    With ``sources`` only mail of active configured labels is taken in; the registry is read
    anew for every micro-batch. ``runs`` names a table of sync runs that each batch and, for every active source, the
    run itself are written to, as of ``run_at``.

    Every micro-batch drops ids that other batches have stored. That holds for a message however
    late it arrives, where a watermark would discard it, and needs no state that grows with
    the mail. A batch has a folder of its own in the store, which it replaces if a failure
    makes it run again, so it adds nothing twice and loses nothing.
    """
    ids = store_ids(spark, store, schema)
    with_batch = StructType([*schema.fields, StructField("batch", StringType())])
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    when = run_at or dt.datetime.now(dt.timezone.utc)
    taken = 0

    def take_in(batch: DataFrame, number: int) -> None:
        nonlocal taken
        key = f"{stream}-{number}"
        if sources is not None:
            batch = batch.join(active_sources(sources).select("label").distinct(), "label", "left_semi").select(*batch.columns)
        write_batch(first_arrivals(ids.unseen(batch, key)), store, key)
        written = spark.read.schema(with_batch).parquet(store).where(F.col("batch") == key)
        n = written.count()
        if not n:
            return
        taken += n
        ids.add(written, key)
        if runs is not None:
            rows = written.groupBy("label").agg(F.count(F.lit(1)).alias("n_taken"), F.max("received_at").alias("newest_at"))
            record_run(rows, runs, when, key)

    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(incoming)
        .writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if runs is not None and sources is not None:
        idle = active_sources(sources).select("label").distinct()
        zeros = {"n_taken": F.lit(0).cast("long"), "newest_at": F.lit(None).cast("timestamp")}
        record_run(idle.withColumns(zeros), runs, when, f"run-{stream}-{when.timestamp():.6f}")
    return taken


def record_run(rows: DataFrame, runs: str, when: dt.datetime, batch: str) -> None:
    """Write a batch's ``label, n_taken, newest_at`` to the table of runs, in place of an earlier try of it."""
    at = F.lit(when).cast("timestamp")
    (
        rows.select("label", at.alias("synced_at"), "n_taken", "newest_at", F.lit(batch).alias("batch"))
        .coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(runs)
    )
