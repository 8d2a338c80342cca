import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peneira import schemas
from peneira.session import scratch_path
from peneira.sources import messages as M
from peneira.sources.known_ids import open_ids
from peneira.sources import registry as R
from peneira.sources import tables as W
from peneira.streaming.sync import store_ids, sync_stream

SCHEMA = "message_id string, label string, received_at timestamp, raw_text string, raw_html string"


def mail(message_id, label="A", minute=0, text="t"):
    return (message_id, label, dt.datetime(2024, 1, 1, 0, minute), text, None)


@pytest.fixture
def sources(spark):
    return spark.createDataFrame(
        [(1, "A", "active"), (2, "B", "inactive"), (3, "A/B", "active")], "source_id long, label string, status string"
    )


def test_only_active_configured_labels_are_opened(spark, sources):
    path = scratch_path(spark, "raw")
    M.append_raw(spark.createDataFrame([mail("1"), mail("2", "B"), mail("3", "C"), mail("4", "A/B")], SCHEMA), path)
    read = M.read_messages(spark, path, sources)
    assert sorted(r["message_id"] for r in read.collect()) == ["1", "4"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_drop_seen(spark):
    new = spark.createDataFrame([mail("1", minute=5), mail("1", minute=2), mail("2"), mail("2")], SCHEMA)
    stored = spark.createDataFrame([mail("2")], SCHEMA)
    assert rows(M.drop_seen(new, stored).select("message_id", F.minute("received_at"))) == [("1", 2)]


def test_check_labels(spark, sources):
    catalog = spark.createDataFrame([("L1", "A"), ("L3", "A/B")], "label_id string, label_path string")
    out = R.check_labels(sources.withColumn("label_id", F.lit(None).cast("string")), catalog)
    assert rows(out) == [
        (1, "A", "L1", "found", None, 1), (2, "B", None, "missing", None, 1), (3, "A/B", "L3", "found", "A", 2),
    ]


def test_stream_takes_each_message_once_however_late(spark):
    incoming, store, state = (scratch_path(spark, n) for n in ("in", "store", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [
        [mail("1", minute=50), mail("2", minute=51), mail("1", minute=49)],
        [mail("2", minute=52), mail("3", minute=1)],
        [],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(incoming)
        sync_stream(spark, incoming, store, state, schema, max_files=1)
    assert sorted(r["message_id"] for r in spark.read.parquet(store).collect()) == ["1", "2", "3"]


def test_known_ids_answer_as_a_plain_look_up(spark):
    known = open_ids(spark, scratch_path(spark, "ids"), expected=60, buckets=4)
    column = lambda values: spark.createDataFrame([(v,) for v in values], "message_id string")
    assert known.unseen(column(["a", "a", None])).count() == 3
    for batch in range(3):
        known.add(column([*(f"m{k}" for k in range(batch * 100, batch * 100 + 150)), None]), f"b{batch}")
    again = open_ids(spark, known.path, buckets=64)
    assert again.buckets == 4
    asked = [*(f"m{k}" for k in range(0, 700, 7)), "m7", None]
    assert rows(again.unseen(column(asked))) == sorted([(v,) for v in asked if v is None or int(v[1:]) >= 350], key=repr)
    # A batch that runs again does not know its own ids.
    assert rows(again.unseen(column(["m1", "m120", "m349"]), "b2")) == [("m349",)]
    assert known.suspects(column([f"m{k}" for k in range(350)])).count() == 350


def test_filter_spares_most_look_ups(spark):
    known = open_ids(spark, scratch_path(spark, "ids"), expected=5000, buckets=4)
    known.add(spark.range(5000).select(F.concat(F.lit("m"), "id").alias("message_id")))
    others = spark.range(5000, 15000).select(F.concat(F.lit("m"), "id").alias("message_id"))
    assert known.suspects(others).count() < 600


def test_stored_ids_are_not_shuffled(spark, request):
    known = open_ids(spark, scratch_path(spark, "ids"), buckets=16)
    known.add(spark.range(1000).select(F.col("id").cast("string").alias("message_id")))
    new = spark.range(500, 1500).select(F.col("id").cast("string").alias("message_id"))
    # As for a store too large to broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    for df, table in ((known.known(new), "_ids"), (known.suspects(new), "_words")):
        lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        scans = [k for k, line in enumerate(lines) if "FileScan" in line and table in line]
        assert scans
        for k in scans:
            depth = len(lines[k]) - len(lines[k].lstrip(" :+-"))
            for line in reversed(lines[:k]):
                above = len(line) - len(line.lstrip(" :+-"))
                if above < depth:
                    depth = above
                    assert "Exchange" not in line, line
        assert df.count() >= 500


def test_sync_seeds_the_ids_of_an_older_store(spark):
    incoming, store, state = (scratch_path(spark, n) for n in ("in", "store", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    M.write_batch(spark.createDataFrame([mail("1"), mail("2")], schema), store, "0")
    spark.createDataFrame([mail("2"), mail("3")], schema).write.parquet(incoming)
    assert sync_stream(spark, incoming, store, state, schema) == 1
    assert sorted(r["message_id"] for r in spark.read.parquet(store).collect()) == ["1", "2", "3"]


def test_batch_that_runs_again_adds_and_loses_nothing(spark):
    store = scratch_path(spark, "store")
    schema = spark.createDataFrame([], SCHEMA).schema
    ids = store_ids(spark, store, schema)
    batch = spark.createDataFrame([mail("1"), mail("2", "B")], schema)
    for _ in range(2):
        M.write_batch(M.first_arrivals(ids.unseen(batch, "k-0")), store, "k-0")
        ids.add(spark.read.parquet(store).where("batch = 'k-0'"), "k-0")
    assert sorted(r["message_id"] for r in spark.read.parquet(store).collect()) == ["1", "2"]


def test_runs_are_recorded_without_mail_too(spark):
    incoming, store, state, runs = (scratch_path(spark, n) for n in ("in", "store", "state", "runs"))
    schema = spark.createDataFrame([], SCHEMA).schema
    registry = spark.createDataFrame(
        [("A", "active", None), ("B", "inactive", dt.datetime(2023, 5, 1)), ("C", "active", dt.datetime(2025, 1, 1))],
        "label string, status string, last_sync_at timestamp",
    )
    first, second = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 2, 2, tzinfo=dt.timezone.utc)
    spark.createDataFrame([mail("1"), mail("2", "B"), mail("3")], schema).write.parquet(incoming)
    assert sync_stream(spark, incoming, store, state, schema, sources=registry, runs=runs, run_at=first) == 2
    assert sync_stream(spark, incoming, store, state, schema, sources=registry, runs=runs, run_at=second) == 0
    ledger = spark.read.parquet(runs)
    assert rows(ledger.groupBy("label").agg(F.sum("n_taken"), F.count_distinct("synced_at"))) == [("A", 2, 2), ("C", 0, 2)]
    got = {r["label"]: r["last_sync_at"] for r in R.record_sync(registry, ledger).collect()}
    assert got == {"A": dt.datetime(2024, 2, 2), "B": dt.datetime(2023, 5, 1), "C": dt.datetime(2025, 1, 1)}


def test_merge_replaces_only_changed_keys(spark):
    path = scratch_path(spark, "t")
    W.write_table(spark.createDataFrame([(i, "old") for i in range(50)], "k long, v string"), path, ["k"], 8)
    W.merge_table(spark.createDataFrame([(3, "new"), (99, "new")], "k long, v string"), path, ["k"], 8)
    out = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(out) == 51 and out[3] == out[99] == "new" and out[4] == "old"


def test_status_and_summary(spark, sources):
    mails = spark.createDataFrame([mail("1"), mail("2"), mail("3"), mail("4", "B")], SCHEMA)
    jobs = spark.createDataFrame([("1", []), ("2", ["url"]), ("2", [])], "message_id string, missing_fields array<string>")
    failures = spark.createDataFrame([("3", "no_posting_found")], "message_id string, error string")
    status = M.message_status(mails, jobs, failures)
    assert [(r["message_id"], r["status"], r["n_jobs"]) for r in status.orderBy("message_id").collect()] == [
        ("1", "parsed", 1), ("2", "incomplete", 2), ("3", "failed", 0), ("4", "new", 0),
    ]
    summary = {r["label"]: (r["n_messages"], r["n_new"], r["n_failed"]) for r in M.sync_summary(status, sources).collect()}
    assert summary == {"A": (3, 0, 1), "B": (1, 1, 0), "A/B": (0, 0, 0)}


def test_contract_names_what_is_wrong(spark):
    with pytest.raises(schemas.ContractError, match="label_path: expected string, found nothing"):
        schemas.assert_contract(spark.createDataFrame([("x",)], "label_id string"), schemas.LABEL_CATALOG)
