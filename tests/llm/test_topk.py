"""Exact nearest vectors against all products."""

import math

import duckdb
import numpy as np
import pytest
from corpus_fixtures import found
from pyspark.sql import functions as F

from peneira.llm import queries, topk

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


def steps(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(1024 * x) for x in vector]


def plain(rows, k):
    """``query_id, rank, vec_id, score`` by all products of whole numbers."""
    kept = [(i, vec_id, v) for i, (vec_id, vector) in enumerate(rows) if (v := steps(vector)) is not None]
    out = []
    for i, vec_id, q in kept:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(q, v, strict=False)), -(2**63)), 2**63 - 1), c is None, c or 0, c) for j, c, v in kept if j != i]
        out += [(vec_id, r, c, -s) for r, (s, _, _, c) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=repr)


def check(spark, rows, k=10):
    got = topk.nearest(spark.createDataFrame(rows, SCHEMA), k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert found(got) == plain(rows, k)


def vectors(seed, n, dims, spread=1.0, centres=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * spread
    if centres:
        x += (rng.normal(size=(centres, dims)) * 5)[rng.integers(0, centres, n)]
    return x


def test_query_over_the_whole_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    assert found(queries.QUERIES["op13_topk_join"](spark, SF)) == plain(rows, 10)


def test_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "LEAST_CHUNK", 100)
    monkeypatch.setattr(topk, "SLICE", 32)
    for centres in (0, 6):
        x = vectors(13, 2500, 8, 0.2, centres)
        check(spark, [(int(k), v.tolist()) for k, v in enumerate(x)])


def test_one_vector_for_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "LEAST_CHUNK", 64)
    x = vectors(3, 900, 5, 0.5)
    check(spark, [(k, (x[0] if k % 3 == 0 else x[k]).tolist()) for k in range(900)])


def test_only_needed_rows_are_sent(spark):
    x = vectors(5, 4000, 6, 0.05, 12)
    data = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA)
    rows = topk.stage(topk.quantised(data), "t")
    asked = F.col("vec_id") % 100 == 0
    cells = topk._choose_cells(rows, 40, 10)
    placed = topk.stage(topk._assigned(rows, cells), "t")
    summary = placed.groupBy("cell").count()
    assert summary.count() == 7
    points = placed.where("vec_id % 7 = 0").select("row", "width", "vec")
    blocks = topk._blocks(topk._with_floor(placed.where(asked), cells, points, 10), cells)
    monkey = topk.Blocks(blocks.cell, blocks.floor, blocks.radius, blocks.norm, np.arange(len(blocks.cell)), blocks.many)
    sent = topk._replicated(placed, cells, monkey).count()
    assert sent < 4000 * len(blocks.cell) / 2


def test_awkward_rows(spark):
    big = [3.0e30, -2.0, 1.0]
    rows = [
        (0, [1.0, 0.5]), (0, [1.0, 0.5]), (100, [0.25, -0.0004, 9.0]), (200, None), (300, []), (400, [float("nan"), 1.0]),
        (500, [None, 1.0]), (600, [float("inf")]), (None, [1.0, 0.5]), (7, [1.0, 0.5]), (3, [1.0, 0.5]), (-100, [-1.0, 2.0]),
    ]
    check(spark, rows)
    check(spark, rows, 2)
    check(spark, rows[:1])
    check(spark, [(1, [1.0])])
    assert topk.nearest(spark.createDataFrame([], SCHEMA), 10).count() == 0
    check(spark, [(k * 50, [float(2**20 + k), -1.5 * k, float(2**10)]) for k in range(9)] + [(1, [1.0])], 3)
    check(spark, [(0, big), (100, big), (2, [-3.0e30]), (3, [5.0e-3])], 3)
    other = spark.createDataFrame([(k, [float(k)], 1, 2, "x", 0) for k in range(200)], "vec_id long, embedding array<float>, row int, cell int, vec string, rank int")
    assert topk.nearest(other, 10).count() == 20


@pytest.mark.parametrize("k", [1, 25])
def test_other_depths_and_queries(spark, k):
    x = vectors(9, 600, 4, 0.3)
    rows = [(j * 100 if j < 5 else j * 100 + 1, v.tolist()) for j, v in enumerate(x)]
    data = spark.createDataFrame(rows, SCHEMA)
    assert found(topk.nearest(data, k, F.col("vec_id") < 500)) == plain(rows, k)
