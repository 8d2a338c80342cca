"""Shards that are runs of a Hilbert curve through the metadata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peneira.llm.common import partitions_for, prefix_sums, whole_text
from peneira.session import stage

BITS = 6
DIMENSIONS = ("lang", "source", "n_chars")
ROWS_PER_RANGE = 2_000_000
_LOCAL = (1 << 33) - 1


def curve_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``axes`` (rows x dimensions, ``bits`` bits each).

    The coordinates are rotated and exchanged bit plane by bit plane from the highest
    (Skilling, 2004), then Gray-decoded and interleaved.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ranks(df: DataFrame, order: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """``df``, stored, with the number (or summed ``weight``) of rows before each row in ``order``.

    Rows are cut into ranges, sorted and numbered inside each; what lies before a range
    is added from one count per range. No task sees more than its range.
    """
    rows = df.count()
    ranged = df.repartitionByRange(partitions_for(rows, ROWS_PER_RANGE), *order).sortWithinPartitions(*order)
    numbered = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumns({"_range": F.shiftright("_at", 33).cast("int"), "_local": F.col("_at").bitwiseAND(_LOCAL)})
    if weight is None:
        sums = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        starts = prefix_sums(sums, "_range", ["_n"], "_n", "_start").select("_range", "_start")
        return numbered.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_local")).drop("_at", "_range", "_local", "_start")
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = numbered.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    sums = numbered.groupBy("_range").agg(F.sum(weight).alias("_n"))
    starts = prefix_sums(sums, "_range", ["_n"], "_n", "_start").select("_range", "_start")
    return local.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_at", "_range", "_local", "_start", "_inside")


def quantised(df: DataFrame, column: str, bits: int) -> DataFrame:
    """``value, bin``: order-keeping bins of about equal row counts over a column's distinct values.

    Null is the lowest value. One value is never split over two bins.
    """
    values = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    before = ranks(values, ["value"], "before", weight="n")
    total = before.agg(F.sum("n")).scalar()
    return before.select("value", F.floor(F.col("before") * (1 << bits) / total).cast("int").alias("bin"))


def hilbert_shards(
    docs: DataFrame,
    shards: int = 8,
    dimensions: Sequence[str] = DIMENSIONS,
    tie: Sequence[str] = ("doc_id",),
    bits: int = BITS,
) -> DataFrame:
    """The rows with ``curve``, ``shard`` and ``slot``, which replace columns of these names.

    Every dimension is quantised, rows are ordered by curve index and ``tie``, and the order
    is cut into ``shards`` runs whose row counts differ by one at most. A run covers a
    compact box of the metadata, so its files' minima and maxima rule it out for most
    filters on any of the dimensions. Null metadata has a bin of its own kind (the lowest);
    repeated rows keep separate slots; an empty table gives no rows.
    """
    marked = docs.select(
        F.struct("*").alias("_row"),
        *[F.col(c).alias(f"_d{k}") for k, c in enumerate(dimensions)],
        *[F.col(c).alias(f"_t{k}") for k, c in enumerate(tie)],
    )
    for k, column in enumerate(dimensions):
        bins = quantised(docs, column, bits).select(F.col("value").alias(f"_v{k}"), F.col("bin").alias(f"_b{k}"))
        marked = marked.join(bins, F.col(f"_d{k}").eqNullSafe(F.col(f"_v{k}")), "left")

    @F.pandas_udf("long")
    def index(cells):  # noqa: ANN001, ANN202
        import pandas as pd

        axes = np.array(cells.tolist(), dtype=np.int64).reshape(len(cells), len(dimensions))
        return pd.Series(curve_index(axes, bits))

    cells = F.array(*[F.coalesce(f"_b{k}", F.lit(0)) for k in range(len(dimensions))])
    ties = [f"_t{k}" for k in range(len(tie))]
    ranked = ranks(marked.select("_row", index(cells).alias("curve"), *ties), ["curve", *ties], "_rank")
    total = docs.count()
    # Run s starts at rank floor(s * total / shards).
    placed = ranked.withColumn("shard", F.call_function("div", (F.col("_rank") + 1) * shards - 1, F.lit(total)).cast("int"))
    first = F.call_function("div", F.col("shard").cast("long") * total, F.lit(shards))
    slot = (F.col("_rank") - first).cast("long").alias("slot")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("curve", "shard", "slot")]
    return placed.select(*kept, "curve", "shard", slot)


def document_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row under the ``rows`` law."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        "source",
        "n_chars",
        (F.octet_length(whole_text()) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"),
    )
    placed = hilbert_shards(stage(narrow, "sizes"), shards, tie=("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, dimensions: Sequence[str] = DIMENSIONS) -> None:
    """Write whole rows as Parquet, one folder per shard, each file a run in curve order."""
    placed = hilbert_shards(stage(docs, "rows"), shards, dimensions)
    files = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    files.write.partitionBy("shard").parquet(path)
