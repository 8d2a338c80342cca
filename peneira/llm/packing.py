"""Pack documents into sequences of a fixed number of tokens by exact complements."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peneira.llm.common import whole_text
from peneira.llm.encoding import VOCABULARY, encoder, texts
from peneira.session import stage

CAPACITY = 1024

Pattern = tuple[tuple[int, ...], int]


class _Complements:
    """Lengths still to be had, looked up by the sum of one, two or three of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def _usable(self, *lengths: int) -> bool:
        return all(self.counts[v] >= lengths.count(v) for v in lengths)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths adding up to ``gap``, the longest first that can be had."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        found = (self.counts[a] > 0) & (self.counts[gap - a] > 0)
        for v in a[found]:
            if self._usable(int(v), gap - int(v)):
                return int(v), gap - int(v)
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths adding up to ``gap``: the longest first, then a pair no longer than it."""
        there = np.flatnonzero(self.counts[: gap - 1] > 0)
        for v in there[::-1]:
            first, rest = int(v), gap - int(v)
            if first * 3 < gap:
                break
            b = np.arange(min(first, rest - 1), (rest - 1) // 2, -1)
            found = (self.counts[b] > 0) & (self.counts[rest - b] > 0)
            for w in b[found]:
                if self._usable(first, int(w), rest - int(w)):
                    return first, int(w), rest - int(w)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def best_fit(self, gap: int) -> int:
        """The longest length that still fits, 0 if none does."""
        there = np.flatnonzero(self.counts[: gap + 1] > 0)
        return int(there[-1]) if len(there) else 0


def packing_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of lengths and how many sequences use each; every piece is used once.

    The longest length left opens a sequence. A single, a pair or a triple whose sum is
    exactly the gap closes it; without one the longest that fits goes in and the search
    is made again for what remains. A pattern is repeated while all its lengths last, so the
    work depends on the number of distinct lengths (at most ``capacity``), not of documents.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        counts[length] = n
    left, plan = _Complements(counts), []
    longest = capacity
    while True:
        while longest and counts[longest] == 0:
            longest -= 1
        if not longest:
            return plan
        pattern, gap = [longest], capacity - longest
        counts[longest] -= 1
        while gap:
            closing = left.exact(gap)
            chosen = closing or ((best,) if (best := left.best_fit(gap)) else ())
            if not chosen:
                break
            for v in chosen:
                counts[v] -= 1
            pattern += chosen
            gap -= sum(chosen)
        for v in pattern:
            counts[v] += 1
        need = {v: pattern.count(v) for v in pattern}
        times = min(int(counts[v]) // n for v, n in need.items())
        for v, n in need.items():
            counts[v] -= n * times
        plan.append((tuple(pattern), times))


def slots(plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """``length, first_rank, end_rank, first_sequence, offset`` for each place in each pattern.

    The ranks of a length's pieces are dealt to its places in turn: rank ``first_rank + i``
    goes to sequence ``first_sequence + i`` at ``offset``.
    """
    rows, sequence, used = [], 0, {}
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, first + times, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return rows


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids, task, task_rank`` of all pieces, stored once.

    A document is the ids of its whole text and ``end_id``. Longer ones are cut so that all
    pieces but the first are full. ``task_rank`` numbers a task's pieces of one length.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, end = encoder(vocabulary), struct.pack("<I", end_id)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for part, words in texts(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), words, strict=True):
                ids = own.ids(text) + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start - 1) % capacity + 1
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], task, rank))
                    start, piece = start + length, piece + 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _PIECE_NAMES)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return stage(chosen.mapInArrow(encode, _PIECES), "pieces")


_PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, task_rank long"
_PIECE_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` instead of ``task`` and ``task_rank``.

    Needs ``length``, ``task`` and ``task_rank`` and keeps every other column. Only the
    histogram of lengths, at most ``capacity`` rows however large the corpus, is planned on
    the driver. Ranks are made of counts per task and length, so pieces of a common length
    are never sorted or gathered.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = packing_plan({r["length"]: r["n"] for r in histogram}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = sorted(slots(plan))
    firsts = {}
    for k, row in enumerate(table):
        firsts.setdefault(row[0], []).append(k)
    lengths = {length: np.array([table[k][1] for k in rows]) for length, rows in firsts.items()}
    targets = {length: np.array([table[k][3:] for k in rows]) for length, rows in firsts.items()}
    shared = spark.sparkContext.broadcast((lengths, targets))  # one row per place in a pattern: bounded by the capacity

    @F.pandas_udf("sequence_id long, offset long")
    def find(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        ends, goals = shared.value
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(sizes), 2), dtype=np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            k = np.searchsorted(ends[size], ranks[rows], side="right") - 1
            out[rows, 0] = goals[size][k, 0] + ranks[rows] - ends[size][k]
            out[rows, 1] = goals[size][k, 1]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    ranked = pieces.join(bases, ["task", "length"]).withColumn("_place", find("length", F.col("base") + F.col("task_rank")))
    return ranked.select(
        *[c for c in pieces.columns if c not in ("task", "task_rank")],
        F.col("_place.sequence_id").alias("sequence_id"),
        F.col("_place.offset").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digest of each piece and its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are documents of the end id alone; repeated rows are packed as often
    as they occur; an empty table packs into no sequence; other columns are ignored.
    """
    pieces = encode_pieces(docs, capacity, end_id, vocabulary)
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(narrow, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets`` from placed pieces that still hold their ``ids``.

    A sequence has at most ``capacity`` pieces, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )


def write_sequences(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Write packed sequences as Parquet and return them reread."""
    sequences(place(encode_pieces(docs, capacity), capacity)).write.parquet(path)
    return spark.read.parquet(path)
