import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peneira.operators import keyed
from peneira.operators.clean import dup_by_key
from peneira.operators.groups import _attach_minimum
from peneira.session import stage


def test_salted_join_equals_plain_join_when_one_key_dominates(spark, monkeypatch):
    monkeypatch.setattr(keyed, "ROWS_PER_CELL", 7)
    rng = random.Random(1)
    left = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(20)}") for i in range(300)]
    right = [(i, "hot" if i % 4 == 0 else f"k{rng.randrange(20)}") for i in range(120)]
    a = spark.createDataFrame(left, "a long, k string")
    b = spark.createDataFrame(right, "b long, k string")
    counts = a.groupBy("k").agg(F.count("*").alias("n_left")).join(
        b.groupBy("k").agg(F.count("*").alias("n_right")), "k"
    )
    hot = keyed.hot_keys(counts, ["k"], per_cell=50)
    assert max(r["_left"] for r in hot.collect()) > 1 and max(r["_right"] for r in hot.collect()) > 1
    joined = keyed.salted_join(a, b, ["k"], F.col("a"), F.col("b"), hot, partitions=5)
    assert rows(joined.select("a", "b")) == rows(a.join(b, "k").select("a", "b"))


def test_lookup_keeps_null_and_unknown_keys(spark):
    a = spark.createDataFrame([(i, ["x", None, "y"][i % 3]) for i in range(30)], "a long, k string")
    t = spark.createDataFrame([("x", 1)], "k string, v int")
    found = keyed.lookup(a, t, ["k"])
    assert rows(found.select("a", "v")) == rows(a.join(t, "k", "left").select("a", "v"))


def test_keep_first_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    first = keyed.keep_first(df, ["k"], [F.desc("id")])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert rows(first) == [(0, 95), (1, 96), (2, 97), (3, 98), (4, 99)]


def test_upsert_latest_prefers_changes_and_adds_rows(spark):
    base = spark.createDataFrame([("a", 1, "active"), ("b", 5, "active")], "label string, ts int, status string")
    changes = spark.createDataFrame(
        [("a", 2, "inactive"), ("b", 4, "inactive"), ("c", 1, "active"), ("b", 5, "paused")],
        "label string, ts int, status string",
    )
    out = keyed.upsert_latest(base, changes, ["label"], "ts")
    assert rows(out) == [("a", 2, "inactive"), ("b", 5, "paused"), ("c", 1, "active")]


def test_broadcast_only_within_the_bound(spark):
    df = spark.range(10)
    hinted = keyed.broadcast_if_bounded(df, 10)._jdf.queryExecution().analyzed().toString()
    plain = keyed.broadcast_if_bounded(df, 9)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted and "ResolvedHint" not in plain


def test_no_hot_key_is_left_out_and_huge_counts_do_not_overflow(spark):
    counts = spark.createDataFrame([(k, 4 * 10**9 + k, 4 * 10**9) for k in range(1500)], "k long, n_left long, n_right long")
    hot = keyed.hot_keys(counts, ["k"])
    assert hot.count() == 1500
    assert hot.where("_left > 0 and _right = 2000000").count() == 1500


def test_lookup_reads_its_input_once(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / "rows"))
    t = spark.createDataFrame([(0, "x")], "k long, v string")
    plan = keyed.lookup(spark.read.parquet(str(tmp_path / "rows")), t, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def rows_per_task(df, tmp_path, name):
    """Rows that each task of the last stage writes."""
    df.write.mode("overwrite").parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name)).groupBy(F.input_file_name()).count()


def test_spread_lookup_equals_lookup(spark, monkeypatch):
    monkeypatch.setattr(keyed, "ROWS_PER_CELL", 5)
    a = spark.createDataFrame([(i, ["x", None, "y", "x"][i % 4], i % 3) for i in range(300)], "a long, k string, j int")
    t = spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("z", 1, 3)], "k string, j int, v int")
    got = keyed.spread_lookup(a, t, ["k", "j"], F.col("a"))
    assert got.columns == ["k", "j", "a", "v"]
    assert rows(got.select("a", "v")) == rows(a.join(t, ["k", "j"], "left").select("a", "v"))
    sized = t.join(a.groupBy("k", "j").count(), ["k", "j"], "left")
    assert rows(keyed.spread_lookup(a, sized, ["k", "j"], F.col("a"), "count").select("a", "v")) == rows(got.select("a", "v"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    monkeypatch.setattr(keyed, "ROWS_PER_CELL", 500)
    plain = keyed.spread_lookup(a, t, ["k", "j"], F.col("a"))
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert rows(plain) == rows(got)


@pytest.mark.parametrize("operator", ["dup_by_key", "groups", "null"])
def test_no_task_holds_a_crowded_key(spark, tmp_path, operator):
    """Half of the rows under one key: no task gets over twice a task's share of the rows."""
    n, parts = 400_000, 16
    conf = {
        "spark.sql.shuffle.partitions": str(parts), "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 2 == 0, F.lit("hot") if operator != "null" else F.lit(None).cast("string")).otherwise(F.col("id").cast("string"))
        if operator == "groups":
            edges = stage(spark.range(1, n).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") - 1).alias("b"), F.col("id").alias("a")), "edges")
            out = _attach_minimum(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            jobs = stage(spark.range(n).select(F.col("id").alias("job_id"), key.alias("k"), F.lit(None).cast("date").alias("posted_at")), "jobs")
            out = dup_by_key(jobs, ["k"])
        sizes = [r["count"] for r in rows_per_task(out, tmp_path, operator).collect()]
        assert sum(sizes) >= n - 1 and max(sizes) <= 2 * n / parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
