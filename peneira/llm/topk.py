"""Exact top-k by inner product: a Voronoi join of a query set with all vectors.

Pivots cut queries and data into cells. Each cell's summary holds its size, its radius and the
few rows nearest to its pivot; the rows of all summaries give every query a score that its k
best reach for certain, and every query cell the least of these. A data row goes only to the
query cells it could still matter to, by its distance from their pivots; each task then solves
one block of queries against one chunk of the rows that came.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.llm.common import partitions_for
from peneira.session import stage

SCALE = 1024
# Bounds of what the driver holds and sends to tasks: cells, and bytes of pivots and summaries.
MAX_CELLS = 1024
SUMMARY_BYTES = 32 << 20
# One task meets so many queries and rows; chunks grow with the table so that partial results stay few.
BLOCK_QUERIES = 2048
LEAST_CHUNK, MOST_CHUNK, CHUNK_BYTES = 1 << 13, 1 << 18, 64 << 20
CHUNKS = 64
SLICE = 1024
# Products summed in doubles are exact below 2^53; a few bits are left for bounds. Beyond, whole numbers of any size are used.
EXACT = 2.0**50
# What rounding may take from a bound below EXACT.
SLACK = 8.0
_WIDTHS = ((2, "<i2"), (4, "<i4"), (8, "<i8"))
_LIMIT = 2.0**63 - 1024
_ROW = "row long, vec_id long, width int, vec binary"


def _encode(values: np.ndarray) -> tuple[int, bytes]:
    top = np.abs(values).max(initial=0.0)
    width, kind = next((w, t) for w, t in _WIDTHS if top < 2.0 ** (8 * w - 1) or w == 8)
    return width, values.astype(kind).tobytes()


def _matrix(widths: np.ndarray, vecs: list[bytes], dims: int) -> np.ndarray:
    """Rows of whole numbers as doubles (exact below EXACT); a shorter vector counts as ending in zeros."""
    out = np.zeros((len(vecs), dims))
    for width, kind in _WIDTHS:
        lengths = np.array([len(v) // width for v in vecs]) * (widths == width)
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            out[at, :n] = np.frombuffer(b"".join(vecs[k] for k in at), kind).reshape(len(at), n)
    return out


def _integers(width: int, vec: bytes) -> list[int]:
    return np.frombuffer(vec, dict(_WIDTHS)[width]).tolist()


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``row, vec_id, width, vec``: each component as floor(1024 x) in the fewest bytes.

    Vectors that are null or hold a null, NaN or infinite component have no row. A component
    beyond 64 bits becomes about the largest of its sign.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            lengths = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = np.cumsum(lengths)
            whole = np.clip(np.floor(flat * SCALE), -_LIMIT, _LIMIT)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            kept = np.flatnonzero((bad[ends] == bad[ends - lengths]) & np.array(lists.is_valid().to_numpy(zero_copy_only=False)))
            packed = [_encode(whole[ends[k] - lengths[k] : ends[k]]) for k in kept]
            take = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(take), batch.column("vec_id").take(take),
                    pa.array([w for w, _ in packed], pa.int32()), pa.array([v for _, v in packed], pa.binary()),
                ],
                ["row", "vec_id", "width", "vec"],
            )

    chosen = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    )
    return chosen.mapInArrow(pack, _ROW)


@dataclass(frozen=True)
class Cells:
    """Pivots and the dimensions all vectors are padded to."""

    pivots: np.ndarray
    exact: bool

    @property
    def dims(self) -> int:
        return self.pivots.shape[1]

    def distances(self, x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))


def _columns(batch: pa.RecordBatch | pa.Table, dims: int) -> np.ndarray:
    return _matrix(batch.column("width").to_numpy(), batch.column("vec").to_pylist(), dims)


def _choose_cells(data: DataFrame, n_queries: int, k: int) -> Cells:
    """Pivots from the rows first by hash; a bounded sample fits them, results don't depend on it.

    There are about as many cells as the square root of the queries, MAX_CELLS at most and no
    more than SUMMARY_BYTES of pivots and summary rows allow. Equal vectors are one pivot.
    """
    size = (F.octet_length("vec") / F.col("width")).cast("long")
    top = data.agg(F.max(size).alias("dims"), F.max("width").alias("width")).first()
    dims = max(1, top["dims"] or 0)
    n = max(1, min(MAX_CELLS, math.isqrt(n_queries) + 1, SUMMARY_BYTES // (8 * dims * (k + 2))))
    first = data.select("width", "vec").orderBy(F.xxhash64("vec"), F.xxhash64("row")).limit(2 * n).collect()
    distinct = list(dict.fromkeys((r["width"], bytes(r["vec"])) for r in first))[:n]
    pivots = _matrix(np.array([w for w, _ in distinct]), [v for _, v in distinct], dims)
    # A two-byte component is under 2^15; wider ones are measured.
    largest = 2.0**15 if (top["width"] or 2) == 2 else _largest(data)
    return Cells(pivots, largest * largest * dims < EXACT)


def _largest(data: DataFrame) -> float:
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("width").to_pylist(), batch.column("vec").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([float(max(map(abs, _integers(w, v)), default=0)) for w, v in pairs])], ["top"])

    return data.select("width", "vec").mapInArrow(tops, "top double").agg(F.max("top")).first()[0]


def _assigned(data: DataFrame, cells: Cells) -> DataFrame:
    """Rows with their cell, the distance from its pivot and their length."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch, cells.dims)
            away = cells.distances(x)
            own = away.argmin(1)
            more = [pa.array(own, pa.int32()), pa.array(away[np.arange(len(x)), own]), pa.array(np.sqrt((x * x).sum(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cell", "away", "norm"])

    return data.mapInArrow(assign, f"{_ROW}, cell int, away double, norm double")


def _with_floor(queries: DataFrame, cells: Cells, points: DataFrame, k: int) -> DataFrame:
    """Queries with ``floor``: a score that at least k rows reach, from the rows of the summaries.

    Where fewer rows than that exist, or products are beyond exact doubles, it is minus infinity.
    """
    known = points.toArrow()
    rows, x = known.column("row").to_numpy(), _columns(known, cells.dims)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = np.full(batch.num_rows, -np.inf)
            if cells.exact and len(rows) > k and batch.num_rows:
                scores = _columns(batch, cells.dims) @ x.T
                scores[batch.column("row").to_numpy()[:, None] == rows[None, :]] = -np.inf
                floors = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], [*batch.schema.names, "floor"])

    return queries.mapInArrow(score, f"{_ROW}, cell int, away double, norm double, floor double")


@dataclass(frozen=True)
class Blocks:
    """Query cells and the blocks their queries are solved in.

    ``first`` and ``many`` say which blocks a cell has; a cell of more than BLOCK_QUERIES
    queries has several, small cells near each other share one.
    """

    cell: np.ndarray
    floor: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    many: np.ndarray

    def needed(self, x: np.ndarray, norm: np.ndarray, cells: Cells) -> np.ndarray:
        """Whether a row could reach the floor of a query cell, for rows by cells.

        Two bounds hold for every query of a cell: by its distance from the pivot at most the
        radius, and by the product with the pivot plus radius times length.
        """
        if not cells.exact:
            return np.ones((len(x), len(self.cell)), dtype=bool)
        pivots = cells.pivots[self.cell]
        product = x @ pivots.T
        square = (norm * norm)[:, None]
        away = np.sqrt(np.maximum(square + (pivots * pivots).sum(1) - 2 * product, 0))
        by_distance = (square + self.norm**2 - np.maximum(away - self.radius, 0) ** 2) / 2
        by_product = product + self.radius * norm[:, None]
        return np.minimum(by_distance, by_product) + SLACK >= self.floor


def _blocks(queries: DataFrame, cells: Cells) -> Blocks:
    summary = (
        queries.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("floor").alias("floor"), F.max("away").alias("radius"), F.max("norm").alias("norm"))
        .orderBy("cell").toPandas()
    )
    # Cells in a chain of near neighbours, so that those that share a block need much the same rows.
    left, chain = list(range(len(summary))), []
    pivots = cells.pivots[summary["cell"]]
    while left:
        nearest = min(left, key=lambda j: ((pivots[j] - pivots[chain[-1]]) ** 2).sum() if chain else j)
        left.remove(nearest)
        chain.append(nearest)
    first, many = np.zeros(len(summary), np.int64), np.ones(len(summary), np.int64)
    block, held = 0, 0
    for j in chain:
        n = summary["n"][j]
        if held and held + n > BLOCK_QUERIES:
            block, held = block + 1, 0
        first[j], many[j] = block, -(-n // BLOCK_QUERIES)
        held += n
        if many[j] > 1:
            block, held = block + many[j], 0
    return Blocks(
        summary["cell"].to_numpy(np.int64), summary["floor"].to_numpy(float), summary["radius"].to_numpy(float),
        summary["norm"].to_numpy(float), first, many,
    )


def _replicated(data: DataFrame, cells: Cells, blocks: Blocks) -> DataFrame:
    """``block`` and the row, once for every block that needs it."""
    sizes: dict[int, int] = {}
    for first, many in zip(blocks.first, blocks.many, strict=True):
        sizes |= {int(first): max(sizes.get(int(first), 1), int(many))}

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch, cells.dims)
            needed = blocks.needed(x, batch.column("norm").to_numpy(), cells)
            plain = pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "vec_id", "width", "vec")], ["row", "vec_id", "width", "vec"])
            for first, many in sizes.items():
                at = np.flatnonzero(needed[:, blocks.first == first].any(1))
                if len(at):
                    some = plain.take(pa.array(at))
                    for block in range(first, first + many):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block), pa.int64()), *some.columns], ["block", *some.schema.names])

    return data.mapInArrow(copy, f"block long, {_ROW}")


def _dealt(queries: DataFrame, blocks: Blocks) -> DataFrame:
    """Queries with their block: those of a large cell are dealt over its blocks by row."""
    firsts = dict(zip(blocks.cell.tolist(), zip(blocks.first.tolist(), blocks.many.tolist(), strict=True), strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [firsts[c] for c in batch.column("cell").to_pylist()]
            mixed = [zlib.crc32(r.to_bytes(8)) % m for r, (_, m) in zip(batch.column("row").to_pylist(), found, strict=True)]
            block = pa.array([f + s for (f, _), s in zip(found, mixed, strict=True)], pa.int64())
            names = ["row", "vec_id", "width", "vec", "floor"]
            yield pa.RecordBatch.from_arrays([block, *[batch.column(c) for c in names]], ["block", *names])

    return queries.mapInArrow(deal, f"block long, {_ROW}, floor double")


def _best(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, data: pa.Table, dims: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, candidate, score`` of each query's k best of one chunk whose rows come by id.

    Since ids ascend, a later row that equals a query's k-th score loses the tie, so only
    rows above it are looked at again; before that, rows at the floor count too.
    """
    bar = floor - 1
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for start in range(0, data.num_rows, SLICE):
        part = data.slice(start, SLICE)
        scores = queries @ _columns(part, dims).T
        scores[own[:, None] == part.column("row").to_numpy()[None, :]] = -np.inf
        q, c = np.nonzero(scores > bar[:, None])
        if not len(q):
            continue
        query, candidate, score = (np.concatenate(p) for p in zip(kept, (q, c + start, scores[q, c]), strict=True))
        order = np.lexsort((candidate, -score, query))
        query, candidate, score = query[order], candidate[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = (query[rank < k], candidate[rank < k], score[rank < k])
        bar[query[rank == k - 1]] = score[rank == k - 1]
    return kept


def _whole_best(queries: list[list[int]], own: list[int], x: list[list[int]], rows: list[int], k: int) -> Iterator[tuple[int, int, int]]:
    """The same in whole numbers of any size; a score beyond 64 bits counts as the nearest long."""
    least, most = -(2**63), 2**63 - 1
    for j, q in enumerate(queries):
        scored = ((-min(max(sum(a * b for a, b in zip(q, v, strict=False)), least), most), c) for c, v in enumerate(x) if rows[c] != own[j])
        yield from ((j, c, -s) for s, c in heapq.nsmallest(k, scored))


_FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def _solver(cells: Cells, k: int):
    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        ids = data.column("vec_id")
        data = data.take(pa.array(np.lexsort((data.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))))
        own = queries.column("row").to_numpy()
        if cells.exact:
            q, c, score = _best(_columns(queries, cells.dims), own, queries.column("floor").to_numpy(), data, cells.dims, k)
            score = score.astype(np.int64)
        else:
            lists = [[_integers(w, v) for w, v in zip(t.column("width").to_pylist(), t.column("vec").to_pylist(), strict=True)] for t in (queries, data)]
            found = list(_whole_best(lists[0], own.tolist(), lists[1], data.column("row").to_pylist(), k))
            q, c = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
            score = np.array([f[2] for f in found], np.int64)
        asked, hit = queries.take(pa.array(q)), data.take(pa.array(c))
        return pa.table(
            {"query_row": asked.column("row"), "query_id": asked.column("vec_id"), "row": hit.column("row"), "vec_id": hit.column("vec_id"), "score": pa.array(score)}
        )

    return solve


def nearest(vectors: DataFrame, k: int, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of greatest inner product for every query, exactly.

    Queries are the rows for which ``is_query`` (over ``vec_id``; by default, ids divisible by
    100) holds, candidates all rows but the query's own; ties go to the smaller id, null last. Vectors
    are taken in steps of 1/1024; those that are null or hold a null or non-finite component
    take no part, a shorter one counts as ending in zeros, an empty one scores 0. Rows that
    repeat an id are rows of their own, as queries and as candidates. A score beyond 64 bits
    counts as the nearest long. A query with fewer than k candidates has fewer rows; an empty
    table gives none; other columns are ignored.

    The driver holds at most MAX_CELLS pivots and SUMMARY_BYTES of summaries. Every task holds
    one block of about BLOCK_QUERIES and one chunk of the rows, dealt by hash, so a
    vector that a third of all rows repeat is spread like any other.
    """
    asked = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    data = stage(quantised(vectors, id_col, vector_col), "vectors")
    counts = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("queries")).first()
    spark = vectors.sparkSession
    if not counts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = _choose_cells(data, counts["queries"], k)
    placed = stage(_assigned(data, cells), "cells")
    order = Window.partitionBy("cell").orderBy("away", "row")
    summary = placed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1).select("row", "width", "vec")
    queries = stage(_with_floor(placed.where(asked), cells, summary, k), "queries")
    blocks = _blocks(queries, cells)
    most = max(SLICE, min(MOST_CHUNK, CHUNK_BYTES // (8 * cells.dims)))
    chunks = partitions_for(counts["n"], min(most, max(LEAST_CHUNK, counts["n"] // CHUNKS)))
    sent = _replicated(placed, cells, blocks).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    waiting = _dealt(queries, blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = waiting.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(_solver(cells, k), _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
