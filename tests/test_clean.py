import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from peneira.operators import clean as C


def test_duplicates_keep_the_earliest_and_ignore_null_keys(spark):
    data = [
        ("j1", "Ágil", "Dev", "SP", "https://a.com/1?utm_source=x", dt.date(2024, 1, 2), "d"),
        ("j2", "agil", "DEV", "sp", "https://a.com/2", dt.date(2024, 1, 1), "d"),
        ("j3", "Outra", "QA", "RJ", "HTTP://A.com/1/#f", dt.date(2024, 1, 3), "d"),
        ("j4", None, "QA", "RJ", None, dt.date(2024, 1, 1), "d"),
        ("j5", None, "QA", "RJ", None, None, "d"),
    ]
    jobs = spark.createDataFrame(
        data, "job_id string, company string, title string, location string, url string, posted_at date, description string"
    )
    flagged = C.flag_jobs(jobs)
    assert rows(flagged.select("job_id", "dup_of", "failed")) == [
        ("j1", "j2", False), ("j2", None, False), ("j3", "j2", False), ("j4", None, True), ("j5", None, True),
    ]
    kept = jobs.join(flagged.where("dup_of is null").select("job_id"), "job_id", "left_semi")
    assert C.flag_jobs(kept).where("dup_of is not null").count() == 0


def test_age_limit_is_inclusive(spark):
    df = spark.createDataFrame(
        [("at", dt.date(2024, 1, 1), 30), ("over", dt.date(2023, 12, 31), 30), ("default", dt.date(2023, 12, 31), None), ("none", None, 1)],
        "k string, newest_at date, max_age_days int",
    )
    out = rows(df.select("k", C.stale(F.to_date(F.lit("2024-01-31")))))
    assert out == [("at", False), ("default", True), ("none", False), ("over", True)]


def test_status_order_and_reasons(spark):
    df = spark.createDataFrame(
        [(True, "x", True, ["t"]), (False, "x", True, []), (False, None, False, ["t"]), (False, None, False, [])],
        "failed boolean, dup_of string, stale boolean, incompatible array<string>",
    )
    out = [(r["status"], r["reasons"]) for r in C.resolve_status(df).collect()]
    assert out == [
        ("extraction_failed", ["extraction_failed", "duplicate", "stale", "incompatible"]),
        ("duplicate", ["duplicate", "stale"]), ("incompatible", ["incompatible"]), ("active", []),
    ]


def test_no_group_with_a_usable_fresh_member_disappears(spark):
    """A failed twin hides nothing, and a posting put up again is as fresh as its last copy."""
    data = [
        ("a1", "Co", "Dev", "SP", None, dt.date(2024, 1, 1)),
        ("a2", "Co", "Dev", "SP", "https://a.com/9", dt.date(2024, 5, 1)),
        ("b1", "Two", "QA", "RJ", "https://b.com/1", dt.date(2023, 1, 1)),
        ("b2", "Two", "QA", "RJ", "https://b.com/1?utm_source=x", dt.date(2024, 5, 2)),
        ("c1", "Three", "Ops", "RJ", "https://c.com/1", dt.date(2024, 5, 2)),
        ("c2", "Four", "Ops", "RJ", "https://c.com/2", dt.date(2024, 5, 3)),
    ]
    jobs = spark.createDataFrame(data, "job_id string, company string, title string, location string, url string, posted_at date")
    jobs = jobs.withColumn("description", F.lit("d"))
    near = spark.createDataFrame([("c1", "c2")], "id_a string, id_b string")
    flagged = C.flag_jobs(jobs, near).withColumn("max_age_days", F.lit(30))
    shown = flagged.where("not failed and dup_of is null").where(~C.stale(F.to_date(F.lit("2024-05-10"))))
    assert rows(shown.select("job_id")) == [("a2",), ("b1",), ("c1",)]
    assert rows(flagged.select("job_id", "dup_of")) == [
        ("a1", "a2"), ("a2", None), ("b1", None), ("b2", "b1"), ("c1", None), ("c2", "c1"),
    ]
