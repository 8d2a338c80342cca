"""What must not grow with the input: broadcasts, rows per link, memory of a task."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peneira.operators import groups, keyed, similarity
from peneira.operators.profiles import profile_terms
from peneira.session import apply_settings, stage


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    """300,000 ids take a megabyte on disk and a hundred as a broadcast table."""
    ids = stage(spark.range(300_000).select(F.concat(F.lit("j"), "id").alias("job_id")), "ids")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    try:
        apply_settings(spark)
        plan = ids.join(ids.withColumn("v", F.lit(1)), "job_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan


def test_terms_are_not_sorted_where_profiles_are_read(spark):
    """All aggregation comes after the exchange; below it stand only scan and generator."""
    schema = (
        "profile_id long, roles array<string>, technologies array<string>, seniority array<string>, modalities array<string>, "
        "locations array<string>, required array<string>, avoid_companies array<string>, avoid_areas array<string>, "
        "contract_types array<string>, unwanted array<struct<term:string,action:string>>"
    )
    row = (1, ["Dev", "dev"], ["PHP"], *[[]] * 7, [("rede", None)])
    found = profile_terms(spark.createDataFrame([row, row], schema))
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "Sort" not in below and "Aggregate" not in below
    assert sorted((r["dimension"], r["term"], r["action"]) for r in found.collect()) == [
        ("role", "Dev", "boost"), ("technology", "PHP", "boost"), ("unwanted", "rede", "penalize"),
    ]


def test_shingles_of_one_text_alone_are_not_kept(spark, monkeypatch):
    """Counts and prefixes hold shared shingles only; positions still count the others."""
    kept = {}

    def noted(df, name):
        kept[name] = stage(df, name)
        return kept[name]

    monkeypatch.setattr(similarity, "stage", noted)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "fim"]), *(" ".join(f"u{k}x{i}" for i in range(60)) for k in range(5))]
    found = similarity.near_dup_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 0.8)
    assert [(r["id_a"], r["id_b"]) for r in found.collect()] == [(0, 1)]
    assert kept["frequency"].count() == 55
    assert {r["id"] for r in kept["probes"].select("id").collect()} == {0, 1}
    assert kept["probes"].where("position = 0").count() == 0


def test_tasks_do_not_grow_with_the_pairs_that_meet(spark, monkeypatch):
    """A thousand times the pairs: as many tasks and cells of a grid, and the same rows."""
    for work in (1e10, 1e13):
        tasks, per_cell = keyed.tasks_for(work, 200)
        assert tasks == keyed.MAX_TASKS
        side = int((work / 100) ** 0.5)
        counts = spark.createDataFrame([(k, side, side) for k in range(100)], "k long, n_left long, n_right long")
        cells = keyed.hot_keys(counts, ["k"], per_cell).agg(F.sum(F.col("_left").cast("long") * F.col("_right"))).first()[0]
        assert keyed.MAX_TASKS <= cells <= 2 * keyed.MAX_TASKS
    assert keyed.tasks_for(10, 200) == (200, keyed.WORK_PER_CELL)
    assert keyed.tasks_for(1e13, 5000)[0] == 5000
    monkeypatch.setattr(keyed, "WORK_PER_CELL", 20)
    monkeypatch.setattr(keyed, "ROWS_PER_CELL", 3)
    monkeypatch.setattr(keyed, "MAX_TASKS", 6)
    a, b = spark.range(60).selectExpr("id a", "id % 2 k"), spark.range(50).selectExpr("id b", "id % 2 k")
    sizes = a.groupBy("k").agg(F.count("a").alias("n_left")).join(b.groupBy("k").agg(F.count("b").alias("n_right")), "k")
    tasks, per_cell = keyed.tasks_for(1500, 2)
    hot = keyed.hot_keys(sizes, ["k"], per_cell)
    assert tasks == 6 and hot.where("_left > 1 or _right > 1").count() == 2
    joined = keyed.salted_join(a, b, ["k"], F.col("a"), F.col("b"), hot, tasks)
    assert rows(joined.select("a", "b")) == rows(a.join(b, "k").select("a", "b"))


@pytest.mark.parametrize("kind", ["string", "long", "double"])
def test_all_links_of_a_group_are_not_sent_on(spark, monkeypatch, kind):
    """A group linked pair by pair costs one link per id and task; which ids are joined stays the same."""
    monkeypatch.setattr(groups, "HELD_IDS", 50)
    ids = spark.range(120).selectExpr(f"cast(id as {kind}) as x", "id % 3 as g")
    pairs = ids.join(ids.withColumnRenamed("x", "y"), "g").where("x < y").select(F.col("y").alias("id_a"), F.col("x").alias("id_b"))
    odd = spark.createDataFrame([(None, 5), (5, None), (7, 7), (119, 500)], "id_a long, id_b long").selectExpr(*[f"cast({c} as {kind}) {c}" for c in ("id_a", "id_b")])
    links = pairs.unionByName(odd).coalesce(2)
    clean = links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).where("a != b")
    sent = groups.spanning(clean).count()
    assert sent == clean.count() if kind == "double" else sent <= 2 * 121 * 2
    label = [(r["id"], r["group_id"]) for r in groups.dup_groups(links).collect()]
    key = {"string": str, "long": int, "double": float}[kind]
    same = {g: sorted(key(i) for i in [*range(g, 120, 3), *([500] if g == 119 % 3 else [])]) for g in range(3)}
    assert sorted(label) == sorted((i, min(m)) for m in same.values() for i in m)
    assert groups.spanning(clean.limit(0)).count() == 0


def test_pairs_read_once_are_not_stored(spark, tmp_path, monkeypatch):
    """A query that goes over the pairs once computes its own columns; stored pairs give the same rows."""
    from test_score import job, places, preferences

    from peneira.plans import triage
    from peneira.standin import queries as Q

    wishes = {"roles": ["Dev"], "technologies": ["php"], "contract_types": ["PJ"], "avoid_companies": ["Evil"], "max_age_days": 30}
    jobs = [job(n, title="Dev", description=t, company=c) for n, t, c in
            (("a", "php CLT", "Acme"), ("b", "php PJ", "Evil"), ("c", "php", "Acme"), ("d", "java", "Acme"), ("e", "php", None))]
    table = spark.createDataFrame(jobs, "job_id string, title string, company string, location string, description string, url string, posted_at date")
    table = table.withColumn("posted_at", F.when(F.col("job_id") == "c", F.to_date(F.lit("2001-08-30"))).otherwise(F.to_date(F.lit("1999-01-01"))))
    people = preferences(spark, [(1, wishes), (2, {"roles": ["Dev"]}), (3, {"roles": ["QA"]})])
    found = triage.prepare(table, people, places(spark))
    listed = table.withColumn("source_id", F.lit(1))
    sources = spark.createDataFrame([(1, "s")], "source_id int, name string")
    monkeypatch.setattr(Q, "_stored", {})
    monkeypatch.setattr(Q, "inputs", lambda spark, d: found)
    monkeypatch.setattr(Q.V, "jobs", lambda spark, d: listed)
    monkeypatch.setattr(Q.V, "sources", lambda spark, d: sources)
    written, whole = [], Q.stage
    monkeypatch.setattr(Q, "stage", lambda df, n: written.append(n) or whole(df, n))
    names = ("cln5_flag_stale", "cln6_flag_incompatible", "cln8_resolve_status", "dsh2_min_score")
    once = [rows(Q.QUERIES[name](spark, str(tmp_path))) for name in names]
    assert all(once) and not written
    Q.triaged(spark, str(tmp_path))
    assert written == ["triaged"]
    assert [rows(Q.QUERIES[name](spark, str(tmp_path))) for name in names] == once
