from pyspark.sql import functions as F

from peneira.operators import drafts as D

MATCHED = (
    "profile_id long, job_id string, features array<string>, full_name string, current_role string, "
    "profile_summary string, title string, company string, location string, score int, classification string, "
    "reason string, lang string"
)
EVIDENCE = "profile_id long, kind string, name string, name_norm string, level string, years double, evidence string"


def setup(spark, lang="pt"):
    pairs = spark.createDataFrame(
        [(1, "j", ["term:react", "term:sql"], "Ana {title}", "Dev", None, "Dev React", None, "SP", 90, "Aplicar", "r", lang)], MATCHED
    )
    facts = spark.createDataFrame(
        [(1, "skill", "React", "react", "Avançado", 2.0, "Painéis"), (1, "skill", "SQL", "sql", None, 5.0, "Relatórios"),
         (1, "skill", "PHP", "php", "Básico", 9.0, "Sites"), (2, "skill", "React", "react", None, 1.0, "Outro")], EVIDENCE,
    )
    return pairs, facts


def test_drafts_hold_matched_facts_only_in_order(spark):
    pairs, facts = setup(spark)
    drafts = {r["kind"]: r for r in D.render(D.match_evidence(pairs, facts), F.lit("2024-01-01"), k=1).collect()}
    assert drafts["cv"]["body"] == (
        "Ana {title}\nDev\n\nRelevante para Dev React:\n- SQL: Relatórios\n- React (Avançado): Painéis"
    )
    assert drafts["cv"]["facts_used"] == ["skill:sql", "skill:react"]
    assert drafts["highlights"]["facts_used"] == ["skill:sql"]
    assert drafts["summary"]["facts_used"] == []


def test_no_fact_no_factual_draft(spark):
    pairs, facts = setup(spark)
    drafts = D.render(D.match_evidence(pairs.withColumn("features", F.array(F.lit("term:x"))), facts), F.lit("2024-01-01"))
    assert [r["kind"] for r in drafts.collect()] == ["summary"]


def test_grounding_check_finds_a_planted_fact(spark):
    pairs, facts = setup(spark)
    drafts = D.render(D.match_evidence(pairs, facts), F.lit("2024-01-01"))
    assert D.ungrounded(drafts, facts).count() == 0
    planted = drafts.withColumn("facts_used", F.concat("facts_used", F.array(F.lit("skill:cobol"))))
    assert {r["fact_id"] for r in D.ungrounded(planted, facts).collect()} == {"skill:cobol"}


def test_language_choice_and_latest(spark):
    df = spark.createDataFrame([("en", "pt"), (None, "en"), (None, "xx"), ("xx", None)], "p string, j string")
    assert [r[0] for r in df.select(D.pick_lang(F.col("p"), F.col("j"))).collect()] == ["en", "en", "pt", "pt"]
    pairs, facts = setup(spark)
    old = D.render(D.match_evidence(pairs, facts), F.lit("2024-01-01"))
    new = old.withColumns({"body": F.lit("novo"), "created_at": F.lit("2024-02-01").cast("timestamp")})
    assert {r["body"] for r in D.latest_materials(old.unionByName(new)).collect()} == {"novo"}
