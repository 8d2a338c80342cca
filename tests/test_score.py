import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peneira import schemas
from peneira.operators import profiles as P
from peneira.operators import score as S
from peneira.operators import tagging as T
from peneira.plans import triage

JOB = "job_id string, title string, company string, location string, description string, url string, posted_at date"
WORDS = ["react", "php", "java", "node.js", "c++", "sql"]


def job(job_id, title="Dev React", location="São Paulo", description="", company="Acme"):
    return (job_id, title, company, location, description, f"https://x.com/{job_id}", None)


def preferences(spark, people):
    """People given as (id, dict of preference lists); everything else is empty."""
    names = ("roles", "seniority", "technologies", "modalities", "locations", "required", "unwanted",
             "avoid_companies", "avoid_areas", "interest_areas", "contract_types")
    data = [
        (i, *[p.get(n, []) for n in names], None, p.get("min_score"), p.get("max_age_days")) for i, p in people
    ]
    df = spark.createDataFrame(data, schemas.PREFERENCES)
    return df.withColumns({"version": F.lit(1), "material_lang": F.lit("pt"), "summary": F.lit("x")})


def places(spark):
    return spark.createDataFrame([("São Paulo", "Brasil"), ("Lisboa", "Portugal")], "place string, parent string")


def run(spark, jobs, people, threshold=0):
    inputs = triage.prepare(spark.createDataFrame(jobs, JOB), preferences(spark, people), places(spark))
    return triage.score(inputs, F.lit(float(threshold)))


FULL = {
    "roles": ["Dev React"], "technologies": ["React", "Node.js"], "seniority": ["Sênior"],
    "modalities": ["Remoto"], "locations": ["Brasil"],
}


@pytest.mark.parametrize(
    "wish, text, expected",
    [
        (FULL, "Sênior, Remoto, Node.js", 100),
        (FULL, "Sênior, Remoto", 83),  # one of two technologies: 100 - 17.5, half up
        (FULL, "Pleno, Presencial", 58),
        (FULL | {"required": ["Node.js", "PHP"]}, "Pleno, Presencial e Node.js", 85),
        (FULL | {"unwanted": [{"term": "PHP", "action": "penalize"}]}, "Sênior, Remoto, Node.js, PHP", 75),
        (FULL | {"unwanted": [{"term": "PHP", "action": "penalize"}]}, "Sênior, Remoto, Node.js, phpunit", 100),
        ({"technologies": ["C++"]}, "C++.", 100),
        ({"required": ["C++"]}, "C++", 20),
        ({"locations": ["Remoto Brasil"]}, "remoto", 100),
    ],
)
def test_golden_scores(spark, wish, text, expected):
    got = run(spark, [job("j", description=text)], [(1, wish)])
    assert [r["score"] for r in got.collect()] == [expected]


def test_class_cutoffs(spark):
    df = spark.createDataFrame([(x,) for x in (0, 49, 50, 79, 80, 100)], "s int")
    assert [r[0] for r in df.select(S.classify(F.col("s"))).collect()] == [
        "Ignorar", "Ignorar", "Avaliar", "Avaliar", "Aplicar", "Aplicar",
    ]


def random_world(seed):
    rng = random.Random(seed)
    some = lambda pool, k: rng.sample(pool, rng.randrange(0, k + 1))
    jobs = [
        job(f"j{i}", title=" ".join(["Dev", rng.choice(WORDS)]), location=rng.choice(["São Paulo", "Lisboa", "Marte"]),
            description=", ".join(some(WORDS, 4) + some(["Remoto", "Híbrido"], 1) + some(["Pleno", "Lead"], 1)))
        for i in range(60)
    ]
    people = [
        (i, {
            "roles": [f"Dev {w}" for w in some(WORDS, 2)], "technologies": some(WORDS, 4),
            "seniority": some(["Pleno", "Sênior", "Lead"], 2), "modalities": some(["Remoto", "Híbrido"], 2),
            "locations": some(["São Paulo", "Portugal", "Remoto global"], 2), "required": some(WORDS, 2),
            "unwanted": [{"term": w, "action": "penalize"} for w in some(WORDS, 2)],
        })
        for i in range(25)
    ]
    return jobs, people


@pytest.mark.parametrize("threshold", [0, 35, 60, 85])
def test_pruned_join_equals_scoring_every_pair(spark, threshold):
    """Every pair scored by a plain product of the two small tables is the brute force here."""
    jobs, people = random_world(7)
    inputs = triage.prepare(spark.createDataFrame(jobs, JOB), preferences(spark, people), places(spark))
    every = inputs.postings.crossJoin(inputs.profiles)
    shares = {f"{d}_share": S.share(d) for d in (*S.DIMENSIONS, "required")} | {"unwanted_hits": S.unwanted_hits()}
    brute = every.withColumns(shares).withColumn("score", S.total_score())
    brute = brute.where(F.col("score") >= max(threshold, 1)).select("profile_id", "job_id", "score")
    got = triage.score(inputs, F.lit(float(threshold))).where("score > 0").select("profile_id", "job_id", "score")
    assert rows(got) == rows(brute)
    assert got.count() > 0


def test_score_properties(spark):
    jobs, people = random_world(11)
    base = {(r["profile_id"], r["job_id"]): r["score"] for r in run(spark, jobs, people).collect()}
    more = [(*j[:4], j[4] + ", sql", *j[5:]) for j in jobs]
    after = {(r["profile_id"], r["job_id"]): r["score"] for r in run(spark, more, people).collect()}
    assert all(0 <= s <= 100 for s in base.values())
    for i, wish in people:
        wanted = "sql" in wish["required"] or "sql" in wish["technologies"] or "Dev sql" in wish["roles"]
        unwanted = any(u["term"] == "sql" for u in wish["unwanted"])
        for j in jobs:
            old, new = base.get((i, j[0]), 0), after.get((i, j[0]), 0)
            if wanted and not unwanted:
                assert new >= old
            if unwanted and not wanted:
                assert new <= old


def test_explanation_and_ranking(spark):
    jobs = [job("a", description="Sênior, Remoto, PHP"), job("b", description="Sênior, Remoto, Node.js")]
    wish = FULL | {"unwanted": [{"term": "PHP", "action": "penalize"}]}
    scored = run(spark, jobs, [(1, wish)])
    a = scored.where("job_id = 'a'").select(S.strengths(), S.gaps(), S.reason()).first()
    assert a[0] == ["location: brasil", "modality: remoto", "role: dev react", "seniority: senior", "technology: react"]
    assert a[1] == ["technology: node.js"]
    assert a[2] == (
        "Avaliar (58): cargo compatível; tecnologias 1/2; senioridade compatível; modalidade compatível; "
        "localização compatível; termos indesejados 1."
    )
    points = {r["dimension"]: r["points"] for r in S.score_breakdown(scored.where("job_id = 'a'")).collect()}
    assert points == {"role": 25, "technology": 17.5, "seniority": 15, "modality": 10, "location": 15, "unwanted": -25}
    assert [r["job_id"] for r in S.rank_jobs(scored, 1).collect()] == ["b"]
    done = S.analyses(scored, F.lit("2024-01-01"))
    schemas.assert_contract(done, schemas.ANALYSES)
    assert S.stale_pairs(scored, done).count() == 0
    assert S.stale_pairs(scored.withColumn("version", F.lit(2)), done).count() == 2


def test_scoring_plan_has_no_python_and_no_product(spark):
    jobs, people = random_world(2)
    plan = run(spark, jobs, people, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_long_form_and_versions(spark):
    terms = P.profile_terms(preferences(spark, [(1, {"technologies": ["React", "react ", ""], "unwanted": [
        {"term": "PHP", "action": "discard"}, {"term": "php", "action": "penalize"}]})]))
    assert rows(terms.select("dimension", "term_norm", "action")) == [
        ("technology", "react", "boost"), ("unwanted", "php", "discard"),
    ]
    stored = spark.createDataFrame([(1, "a", 3, 0), (2, "b", 1, 0)], "profile_id long, summary string, version int, updated_at int")
    edits = spark.createDataFrame([(1, "a", 1, 5), (2, "c", 1, 5), (2, "d", 1, 6), (9, "n", 1, 5)], stored.schema)
    out = rows(P.save_profiles(stored, edits).select("profile_id", "summary", "version"))
    assert out == [(1, "a", 3), (2, "d", 2), (9, "n", 1)]


def test_terms_match_whole_tokens(spark):
    jobs = spark.createDataFrame([("j", "Full Stack", "Node.js. C++, phpunit e São Paulo", None)],
                                 "job_id string, title string, description string, location string")
    known = spark.createDataFrame([(t, True) for t in ("full stack", "node.js", "c++", "php", "sao paulo", "stack node.js")],
                                  "term_norm string, is_technology boolean")
    assert T.tag_terms(jobs, known).first()["terms"] == ["c++", "full stack", "node.js", "sao paulo"]


def test_long_terms_and_places_match(spark):
    """Runs are as long as the dictionary's terms: nothing is cut at a number of words."""
    jobs = [
        ("a", "Desenvolvedor Full Stack React", "Acme", "São José dos Campos", "Remoto", "https://x.com/a", None),
        ("b", "Desenvolvedor Full Stack", "Acme", "São José", "", "https://x.com/b", None),
    ]
    towns = spark.createDataFrame([("São José dos Campos", "Brasil")], "place string, parent string")
    people = [(1, {"roles": ["Desenvolvedor Full Stack React"], "locations": ["São José dos Campos"]})]
    inputs = triage.prepare(spark.createDataFrame(jobs, JOB), preferences(spark, people), towns)
    scored = triage.score(inputs, triage.review_threshold())
    assert rows(scored.select("job_id", "score")) == [("a", 100)]


@pytest.mark.parametrize("min_score", [None, 90])
def test_the_lists_minimum_never_cuts_scoring(spark, min_score):
    """A profile's minimum filters its list; pairs from the review cut-off on are all stored."""
    jobs = [job("full", description="Sênior, Remoto, Node.js"), job("most", description="Sênior, Remoto"),
            job("half", description="Pleno, Presencial"), job("none", title="QA", location="Lisboa")]
    inputs = triage.prepare(spark.createDataFrame(jobs, JOB), preferences(spark, [(1, FULL | {"min_score": min_score})]), places(spark))
    day = F.to_date(F.lit("2024-01-01"))
    stored = triage.triaged(inputs, day)
    assert rows(stored.select("job_id", "score", "classification")) == [
        ("full", 100, "Aplicar"), ("half", 58, "Avaliar"), ("most", 83, "Aplicar"),
    ]
    listed = spark.createDataFrame([(1, j[0]) for j in jobs], "profile_id long, job_id string")
    every = triage.triaged_pairs(inputs, listed, day)
    assert rows(every.select("job_id", "classification")) == [
        ("full", "Aplicar"), ("half", "Avaliar"), ("most", "Aplicar"), ("none", "Ignorar"),
    ]
    assert rows(every.where("score >= 50").select("job_id", "score")) == rows(stored.select("job_id", "score"))


def test_filters_on_flags_are_not_asked_where_pairs_meet(spark):
    """What a pair breaks is looked at once its score is known, also where a query filters on it."""
    people = [(1, FULL | {"avoid_companies": ["Evil"]}), (2, FULL)]
    jobs = [job("a", description="Sênior, Remoto, Node.js", company="Evil"), job("b", description="Sênior, Remoto, Node.js")]
    inputs = triage.prepare(spark.createDataFrame(jobs, JOB), preferences(spark, people), places(spark))
    pairs = triage.triaged(inputs, F.to_date(F.lit("2024-01-01")), apart=True)
    broken = pairs.where(F.size("incompatible") > 0).select("profile_id", "job_id", "incompatible")
    assert rows(broken) == [(1, "a", ["company: evil"])]
    active = pairs.where("status = 'active'").select("profile_id", "job_id")
    assert rows(active) == [(1, "b"), (2, "a"), (2, "b")]
    for found in (broken, active):
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [line for line in plan if "Join Inner" in line and "mask_1_role" in line]
        assert joins and not any("avoid_company" in line for line in joins)


def test_only_active_pairs_are_ranked_and_drafted(spark):
    from peneira.operators import drafts as D

    pairs = spark.createDataFrame(
        [(1, "a", None, 90, "Aplicar", "stale"), (1, "b", None, 85, "Aplicar", "active"), (1, "c", None, 70, "Avaliar", "active")],
        "profile_id long, job_id string, posted_at date, score int, classification string, status string",
    )
    assert [r["job_id"] for r in triage.top_jobs(pairs, 2).orderBy("rank").collect()] == ["b", "c"]
    assert [r["job_id"] for r in D.eligible(pairs).collect()] == ["b"]


@pytest.mark.parametrize("least", [None, 20, 80])
def test_active_pairs_are_found_without_the_others(spark, monkeypatch, least):
    """Only postings that can be active meet profiles; the pairs are those of all pairs that are active."""
    jobs, people = random_world(3)
    people = [(i, p | {"avoid_companies": ["Acme"] if i % 5 == 0 else [], "max_age_days": 10 * (i % 3) or None}) for i, p in people]
    table = spark.createDataFrame([(*j[:6], None if n % 4 else f"2024-01-{1 + n % 28:02d}") for n, j in enumerate(jobs)], JOB.replace("posted_at date", "posted_at string"))
    table = table.withColumns({"posted_at": F.to_date("posted_at"), "url": F.when(F.col("job_id") != "j2", F.col("url"))})
    inputs = triage.prepare(table, preferences(spark, people), places(spark))
    as_of = F.to_date(F.lit("2024-01-30"))
    met, whole = [], triage.candidates
    monkeypatch.setattr(triage, "candidates", lambda i, *a: met.append(i.postings.count()) or whole(i, *a))
    got = triage.active(inputs, as_of, least=least)
    can_be = inputs.postings.where("not failed and dup_of is null").count()
    assert met == [can_be] and can_be < inputs.postings.count()
    want = triage.triaged(inputs, as_of).where("status = 'active'").where(F.col("score") >= (least or 0))
    columns = ("profile_id", "job_id", "score", "classification", "posted_at", "min_score", "modality")
    assert rows(got.select(*columns)) == rows(want.select(*columns))
    assert not got.isEmpty()


def test_drafts_and_ranks_do_not_store_all_pairs(spark, monkeypatch):
    """Queries over active pairs neither store nor read the hidden ones."""
    from conftest import SF_DIR

    from peneira.standin import queries as Q

    monkeypatch.setattr(Q, "_stored", dict(Q._stored))
    for name in ("triaged", "active", "matched", "materials"):
        Q._stored.pop((spark.sparkContext.applicationId, SF_DIR, name), None)
    monkeypatch.setattr(Q, "triaged", lambda *_: pytest.fail("all pairs are stored"))
    assert Q.QUERIES["mat1_eligible"](spark, SF_DIR).where("score < 80").isEmpty()
    assert Q.QUERIES["mat2_ready"](spark, SF_DIR).count() > 0
    assert Q.QUERIES["mat4_tailored_cv"](spark, SF_DIR).count() > 0
    assert Q.QUERIES["scr15_rank_stored"](spark, SF_DIR).count() > 0
    assert Q.active(spark, SF_DIR).where("status != 'active'").isEmpty()
