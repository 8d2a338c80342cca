"""Sinks for jobs, analyses and materials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.session import stage

N_BUCKETS = 64


def write_table(
    df: DataFrame, path: str, keys: Sequence[str], buckets: int = N_BUCKETS
) -> None:
    """Write rows under ``bucket=`` folders by key hash, replacing only the buckets touched.

    With dynamic partition overwrite a rerun over the same keys leaves one copy. The caller
    passes whole buckets (``bucket_of`` selects them), since a bucket is replaced as a unit.
    """
    (
        df.withColumn("bucket", bucket_of(keys, buckets))
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def bucket_of(keys: Sequence[str], buckets: int = N_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_table(
    changed: DataFrame, path: str, keys: Sequence[str], buckets: int = N_BUCKETS
) -> None:
    """Replace the rows of ``changed``'s keys in a bucketed table, keeping all others.

    Only buckets that hold a changed key are read and rewritten: their numbers, at most
    ``buckets``, become a filter on the folders.
    """
    spark = changed.sparkSession
    stored = spark.read.parquet(path)
    touched = [r["bucket"] for r in changed.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect()]
    kept = (
        stored.where(F.col("bucket").isin(touched))
        .join(changed.select(*keys), list(keys), "left_anti")
        .drop("bucket")
    )
    # The target cannot be overwritten while it is read, so the merged buckets are staged.
    write_table(stage(kept.unionByName(changed), "merge"), path, keys, buckets)
