"""Helpers the corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(c: str | Column = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions_for(n: float, per_partition: int) -> int:
    """Partitions that hold about ``per_partition`` of ``n`` each, one at least."""
    return max(1, math.ceil(n / per_partition))


def prefix_sums(sums: DataFrame, outer: str, inner: Sequence[str], value: str, out: str) -> DataFrame:
    """``sums`` with ``out``: the sum of ``value`` over all rows ordered before the row.

    Rows are ordered by ``outer``, then ``inner``. Only one row per ``outer`` value meets in
    one task; ``outer`` is a partition number, so those rows are as few as there are tasks.
    """
    within = Window.partitionBy(outer).orderBy(*inner)
    before = F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sums.groupBy(outer).agg(F.sum(value).alias("_total"))
    across = Window.orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(outer).alias("_outer"), F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_base"))
    return (
        sums.withColumn("_within", before)
        .join(bases, F.col(outer).eqNullSafe(F.col("_outer")))
        .withColumn(out, (F.col("_base") + F.col("_within")).cast("long"))
        .drop("_outer", "_base", "_within")
    )


def spread_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], spread: Column, size: str, how: str = "inner") -> DataFrame:
    """Join many ``rows`` to ``keyed``, which has one row per key and in ``size`` how many rows the key has.

    A key with more than ROWS_PER_SALT rows has them dealt over ``size / ROWS_PER_SALT`` salts
    by ``spread`` and its one keyed row repeated as often, so a key with a third of all rows
    is no single task. Such keys are few: under rows / ROWS_PER_SALT.
    """
    salts = F.coalesce(F.ceil(F.col(size) / ROWS_PER_SALT), F.lit(1)).cast("int")
    hot = keyed.where(F.col(size) > ROWS_PER_SALT).select(*keys, salts.alias("_salts"))
    many = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), many).cast("int")).drop("_salts")
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
