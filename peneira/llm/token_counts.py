"""Exact histogram of encoded lengths and the answers its suffix sums give."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.llm.common import whole_text
from peneira.llm.encoding import VOCABULARY, encoder, texts
from peneira.session import stage

LENGTHS_PER_BAND = 4096


def token_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``n_tokens`` of each row's whole text, null and empty texts as 0; texts never enter a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for _, part in texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(own.ids(t)) // 4 for t in part], pa.int64())], ["n_tokens"])

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length that occurs, with suffix sums.

    ``n_tokens, n_docs``: the histogram. ``docs_from, tokens_from``: documents and tokens of
    this length or longer. ``truncated_total``: tokens left if every document is cut at this
    length. ``total_docs, total_tokens``: of the corpus. Every row counts, repeated ones
    too; an empty table gives no rows. Suffix sums are taken inside bands of lengths and
    over the bands' totals, so no task holds all lengths.
    """
    # Stored: the histogram is small and read twice below, the texts behind it are neither.
    counted = stage(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    counted = counted.withColumn("band", F.floor(F.col("n_tokens") / LENGTHS_PER_BAND))
    tokens = F.col("n_tokens") * F.col("n_docs")
    bands = counted.groupBy("band").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = bands.select(
        "band",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(every).alias("total_docs"),
        F.sum("tokens").over(every).alias("total_tokens"),
    )
    down = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.withColumns({"docs_in": F.sum("n_docs").over(down), "tokens_in": F.sum(tokens).over(down)})
        .join(bands, "band")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("docs_above") + F.col("docs_in")).alias("docs_from"),
            (F.col("tokens_above") + F.col("tokens_in")).alias("tokens_from"),
            (
                F.col("total_tokens")
                - (F.col("tokens_above") + F.col("tokens_in"))
                + F.col("n_tokens") * (F.col("docs_above") + F.col("docs_in"))
            ).alias("truncated_total"),
            "total_docs",
            "total_tokens",
        )
    )


def _next_longer(histogram: DataFrame, points: DataFrame, key: str, at: Column, answer: Sequence[str], width: Column) -> DataFrame:
    """``points(key)``, once each, with the ``answer`` columns of the first histogram row with ``at`` >= the point, null past the last.

    Rows and points are walked together downwards inside bands of ``width``, carrying the last row met; a
    point with no row above it in its band takes the lowest row of the next band that has one. So
    each row is read once however many points there are.
    """
    known = F.struct(*answer)
    rows = histogram.select(at.cast("long").alias("_at"), known.alias("_row"))
    bound = rows.agg(F.max("_at")).scalar()
    asked = points.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_at")).distinct()
    both = rows.withColumn("_asked", F.lit(False)).unionByName(
        asked.withColumns({"_row": F.lit(None).cast(rows.schema["_row"].dataType), "_asked": F.lit(True)})
    )
    # Points below 0 or past the last row share a band each: bands are as few as the rows' range holds.
    band = F.least(F.greatest(F.floor(F.col("_at") / width), F.lit(0)), F.floor(bound / width) + 1)
    both = both.withColumn("_band", band)
    down = Window.partitionBy("_band").orderBy(F.desc("_at"), "_asked").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_found", F.last("_row", ignorenulls=True).over(down))
    lowest = both.groupBy("_band").agg(F.min_by("_row", F.when(~F.col("_asked"), F.col("_at"))).alias("_lowest"))
    above = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    lowest = lowest.select("_band", F.last("_lowest", ignorenulls=True).over(above).alias("_above"))
    found = inside.where("_asked").join(lowest, "_band").select("_at", F.coalesce("_found", "_above").alias("_found"))
    return found.select(F.col("_at").alias(key), "_found.*")


def totals_at(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """Per ``limit``: documents at least that long, tokens in them, and the total when cut there.

    For any limit the answer follows from the next longer length that occurs: nothing lies
    between. Past the longest document no row is longer and the total is the corpus. A limit
    asked for twice is answered once, a null one not at all.
    """
    total = histogram.agg(F.coalesce(F.max("total_tokens"), F.lit(0)))
    found = _next_longer(histogram, limits, "limit", F.col("n_tokens"), ["docs_from", "tokens_from"], F.lit(LENGTHS_PER_BAND))
    known = found.select("limit", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_from", "tokens_from")])
    cut: Column = total.scalar() - F.col("tokens_from") + F.col("limit") * F.col("docs_from")
    return known.select("limit", "docs_from", "tokens_from", cut.alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: DataFrame) -> DataFrame:
    """Per ``share`` in (0, 1]: the smallest length at or under which that share of documents lies.

    An empty histogram answers none.
    """
    total = histogram.agg(F.max("total_docs"))
    under = F.col("total_docs") - F.col("docs_from") + F.col("n_docs")
    asked = stage(shares.select("share", F.ceil(F.col("share") * total.scalar()).cast("long").alias("_docs")).distinct(), "shares")
    found = _next_longer(histogram, asked, "_docs", under, ["n_tokens"], F.ceil(total.scalar() / LENGTHS_PER_BAND)).where("n_tokens is not null")
    return asked.join(found, "_docs").select("share", "n_tokens")
