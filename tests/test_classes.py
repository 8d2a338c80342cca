"""Classes of postings and profiles: rankings and counts equal those over all pairs."""


import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from peneira.operators import classes as K
from peneira.operators import clean as C
from peneira.operators import score as S
from peneira.plans import triage
from peneira.session import stage
from peneira.standin import queries as Q
from peneira.standin import views as V


@pytest.fixture(scope="module")
def inputs(spark):
    return Q.inputs(spark, SF_DIR)


@pytest.fixture(scope="module")
def as_of():
    return F.to_date(F.lit(V.AS_OF))


@pytest.fixture(scope="module")
def copied(spark, inputs):
    """Postings three times over, some copies newer, some without a date: classes with many members."""
    base = inputs.postings.withColumn("copy", F.explode(F.array(*map(F.lit, range(3)))))
    dates = F.when(F.col("copy") == 2, F.lit(None).cast("date")).otherwise(F.date_add("posted_at", F.col("copy")))
    copies = base.withColumns({"posted_at": dates, "newest_at": dates, "job_id": F.concat("job_id", F.lit("-"), "copy")}).drop("copy")
    copies = stage(copies, "copies")
    return triage.Inputs(copies, inputs.profiles, S.feature_counts(copies))


@pytest.mark.parametrize("k", [1, 7, 40])
def test_best_jobs_are_the_first_of_all_pairs(copied, as_of, k):
    want = triage.top_jobs(triage.triaged(copied, as_of), k)
    got = triage.best_jobs(triage.classes(copied, as_of, k), as_of, k)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_classes_hold_every_posting_and_profile_once(copied, as_of):
    found = triage.classes(copied, as_of, 2)
    assert found.posting_heads.agg(F.sum("n_postings")).first()[0] == copied.postings.count()
    assert found.posting_heads.count() < copied.postings.count()
    assert found.posting_heads.agg(F.max(F.size("members"))).first()[0] == 2
    assert found.profile_heads.agg(F.sum("n_profiles")).first()[0] == copied.profiles.count()


def test_active_profiles_without_forming_pairs(spark, copied, as_of):
    """Against the status of every profile with every posting."""
    postings = copied.postings.where("xxhash64(job_id) % 4 = 0")
    skip = lambda df: df.drop(*[c for c in df.columns if c.startswith(("mask_", "signature_"))])
    pairs = skip(copied.profiles).crossJoin(skip(postings))
    status = C.resolve_status(C.flag_pairs(pairs, as_of))
    want = {r["job_id"]: r["n"] for r in status.where("status = 'active'").groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r["job_id"]: r["n_active"] for r in K.active_profiles(postings, copied.profiles, as_of).collect()}
    assert {k: v for k, v in got.items() if v} == want
    assert len(want) > 10 and len(set(want.values())) > 3


def test_counts_add_up_to_all_profiles(copied, as_of):
    found = triage.classes(copied, as_of, 1)
    counts = triage.posting_counts(found, as_of)
    total = counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c != "job_id"]).first()
    n = copied.profiles.count()
    assert counts.count() == copied.postings.count()
    assert counts.where(f"n_aplicar + n_avaliar + n_ignorar + n_hidden != {n} or n_ignorar < 0 or n_hidden < 0").isEmpty()
    pairs = triage.triaged(copied, as_of)
    assert total["n_scored"] == pairs.count()
    assert total["n_aplicar"] == pairs.where("status = 'active' and classification = 'Aplicar'").count()


def test_age_bands_keep_what_profiles_tell_apart(spark):
    ages = spark.createDataFrame([(None,), (0,), (30,), (31,), (365,), (366,), (9999,)], "age int")
    banded = ages.select("age", K.age_band(F.col("age"), [30, 365]).alias("band"))
    assert {r["age"]: r["band"] for r in banded.collect()} == {None: None, 0: 30, 30: 30, 31: 365, 365: 365, 366: 366, 9999: 366}
    assert {r[0]: r[1] for r in ages.select("age", K.age_band(F.col("age"), []).alias("b")).collect()}[31] == 31


def test_empty_tables(spark, inputs, as_of):
    for some in (triage.Inputs(inputs.postings.limit(0), inputs.profiles, None), triage.Inputs(inputs.postings, inputs.profiles.limit(0), None)):
        found = triage.classes(some, as_of, 3)
        assert triage.best_jobs(found, as_of, 3).count() == 0
