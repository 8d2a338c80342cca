"""Keyed row selection and joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORK_PER_CELL = 2_000_000
ROWS_PER_CELL = 2_000
PARTS_PER_TASK = 16
# The driver keeps account of every task, so there are no more of them however many pairs meet.
MAX_TASKS = 2_000


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Spark prunes to one row per key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def hot_keys(
    counts: DataFrame, keys: Sequence[str], per_cell: float = WORK_PER_CELL
) -> DataFrame:
    """Keys of ``counts(keys.., n_left, n_right)`` whose join deserves more than one task.

    Each gets a grid: ``_right`` parts of the right rows by ``_left`` parts of the left rows.
    Every such key is split; none is left out. Where cells hold more than WORK_PER_CELL both of their
    sides are longer, so rows are repeated less often.
    """
    work = F.col("n_left").cast("double") * F.col("n_right")
    right = F.ceil(F.col("n_right") / (ROWS_PER_CELL * math.sqrt(max(1.0, per_cell / WORK_PER_CELL))))
    left = F.ceil(work / right / per_cell)
    return counts.where(work > per_cell).select(*keys, left.cast("int").alias("_left"), right.cast("int").alias("_right"))


def tasks_for(work: float, least: int) -> tuple[int, float]:
    """Tasks of a join in which ``work`` pairs meet, ``least`` or more, and the pairs of a cell of its grid.

    Pairs grow with the product of both sides. From MAX_TASKS on (or ``least``, if that is more) it is the cells that grow,
    not their number: a task streams its pairs, so a longer one takes time and no memory.
    """
    tasks = max(least, min(MAX_TASKS, math.ceil(work / WORK_PER_CELL)))
    return tasks, max(float(WORK_PER_CELL), work / tasks)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Column,
    right_id: Column,
    hot: DataFrame,
    partitions: int | None = None,
) -> DataFrame:
    """Inner equi-join that spreads a hot key over a grid of tasks.

    A hot key's left rows fall into row bands and its right rows into column bands; each
    side is repeated across the other's bands, so every pair meets in exactly one cell.
    ``partitions`` fixes the number of tasks where the output is much larger than the
    input, which size-based coalescing cannot see.
    """
    rows, columns = F.coalesce("_left", F.lit(1)), F.coalesce("_right", F.lit(1))

    def band(identity: Column, n: Column) -> Column:
        return F.pmod(F.xxhash64(identity), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    grid = ["_row", "_column"]
    left = (
        left.join(hot, list(keys), "left")
        .withColumn("_row", band(left_id, rows))
        .withColumn("_column", every(columns))
        .drop("_left", "_right")
    )
    right = (
        right.join(hot, list(keys), "left")
        .withColumn("_column", band(right_id, columns))
        .withColumn("_row", every(rows))
        .drop("_left", "_right")
    )
    on = [*keys, *grid]
    if partitions:
        left, right = left.repartition(partitions, *on), right.repartition(partitions, *on)
    return left.join(right, on).drop(*grid)


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a table with one row per key.

    ``df`` runs once and nothing is counted beforehand. Adaptive execution can split a
    partition in which one key repeats only where it has exchanges of its own on both sides;
    where a key may hold much of ``df``, or ``table`` is an aggregate on the same keys, use
    ``spread_lookup``.
    """
    return df.join(table, list(keys), "left")


def _share(counts: DataFrame, size: str) -> tuple[float, float]:
    """Rows from which a key is crowded, a small part of a task's share, and the rows of the largest key."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = counts.agg(F.sum(size).alias("total"), F.max(size).alias("most")).first()
    return max(ROWS_PER_CELL, (found["total"] or 0) / (PARTS_PER_TASK * parts)), found["most"] or 0


def present(keys: Sequence[str]) -> Column:
    """Whether no key is null."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).isNotNull()
    return found


def spread_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, size: str | None = None) -> DataFrame:
    """``lookup`` that deals a crowded key's rows over several tasks by ``spread``.

    A key with more rows than a sixteenth of a task's share is crowded: its rows go to as many parts,
    several per task to even out, and the one row of ``table`` is repeated for each. There are
    fewer such keys than PARTS_PER_TASK times the shuffle partitions, so they are broadcast. Rows with a
    null key, which match nothing, are dealt over all tasks. Where no key is crowded this is
    ``lookup``. ``size`` names a column of ``table`` that holds how many rows of ``df`` have the
    key; both should be stored tables then, and ``df`` have no null keys. Without it ``df`` is read once more
    to count them, with one row per key and task shuffled.
    """
    if size is None:
        counts, size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "_n"
    else:
        counts = table.select(*keys, size)
    share, most = _share(counts, size)
    if most <= share:
        return lookup(df, table, keys)
    salts = F.ceil(F.col(size) / share).cast("int").alias("_salts")
    crowded = F.broadcast(counts.where(present(keys) & (F.col(size) > share)).select(*keys, salts))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = F.coalesce("_salts", F.lit(1))
    many = F.when(present(keys), several).otherwise(F.lit(parts))
    left = df.join(crowded, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), many).cast("int")).drop("_salts")
    right = table.join(crowded, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), several - 1))).drop("_salts")
    # The salt is part of the key, so a key's rows are not brought together, however ``table`` was made.
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    Beyond that the plain DataFrame comes back and the join shuffles. The count is summed
    per partition; no rows move for it.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def upsert_latest(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], ts: str
) -> DataFrame:
    """Table after applying changes: the row with the latest ``ts`` per key wins.

    On equal times a change beats the stored row.
    """
    both = base.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    rest = [F.desc(c) for c, t in changes.dtypes if c not in (*keys, ts) and not t.startswith("map")]
    return keep_first(both, keys, [F.desc(ts), F.desc("_change"), *rest]).drop("_change")
