import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from peneira import schemas
from peneira.operators import extract as E

SOURCES = [(1, "L", "linkedin"), (2, "I", "indeed"), (3, "G", "generic"), (4, "U", "carta")]
THREE = (
    "Dev React\nAcme\nSão Paulo\nLinha um\nLinha dois\nPublicada: 05/03/2024\nVer vaga: https://x.com/1?utm_source=a"
    "\n------\nDev Java\n\nRio\nVer vaga: https://x.com/2\n------\n\n"
    "Dev PHP\nBeta\nRecife\nPublicada: ontem\nVer vaga: https://x.com/3"
)
MAILS = [
    ("m1", "L", THREE, None),
    ("m2", "I", "Analista\nGama - Belo Horizonte\nTexto da vaga\nPublicado em 2024-03-01\nhttps://i.com/v?jk=7", None),
    ("m3", "G", None, "<p>Cargo: QA</p><p>Empresa: Delta &amp; Cia</p><p>Link: https://g.com/9</p>"),
    ("m4", "U", "Vaga: Suporte\nsem mais nada", None),
    ("m5", "X", "só conversa", None),
    ("m6", "G", " ", None),
]


@pytest.fixture(scope="module")
def mails(spark):
    df = spark.createDataFrame(MAILS, "message_id string, label string, raw_text string, raw_html string")
    return df.withColumn("received_at", F.lit("2024-03-10 08:00:00").cast("timestamp"))


@pytest.fixture(scope="module")
def jobs(spark, mails):
    sources = spark.createDataFrame(SOURCES, "source_id long, label string, parser string")
    return E.extract_jobs(mails, sources).cache()


def test_parser_routing(spark, mails):
    sources = spark.createDataFrame(SOURCES, "source_id long, label string, parser string")
    routed = {r["message_id"]: r["parser"] for r in E.route_parser(mails, sources).collect()}
    assert routed == {"m1": "linkedin", "m2": "indeed", "m3": "generic", "m4": "generic", "m5": "generic", "m6": "generic"}


def test_fields_of_every_layout(jobs):
    got = {r["job_id"]: r for r in jobs.collect()}
    assert sorted(got) == ["m1-1", "m1-2", "m1-3", "m2-1", "m3-1", "m4-1"]
    first = got["m1-1"]
    assert (first["title"], first["company"], first["location"]) == ("Dev React", "Acme", "São Paulo")
    assert first["description"] == "Linha um\nLinha dois"
    assert first["posted_at"] == dt.date(2024, 3, 5) and first["canonical_url"] == "https://x.com/1"
    assert got["m1-2"]["company"] is None and got["m1-2"]["missing_fields"] == ["company", "description"]
    assert got["m1-3"]["posted_at"] == dt.date(2024, 3, 9)
    indeed = got["m2-1"]
    assert (indeed["company"], indeed["location"], indeed["description"]) == ("Gama", "Belo Horizonte", "Texto da vaga")
    assert indeed["canonical_url"] == "https://i.com/v?jk=7"
    assert got["m3-1"]["company"] == "Delta & Cia" and got["m3-1"]["url"] == "https://g.com/9"
    assert got["m4-1"]["title"] == "Suporte" and "url" in got["m4-1"]["missing_fields"]


def test_failures_and_reprocessing(mails, jobs):
    failures = E.extraction_failures(mails, jobs)
    assert rows(failures.select("message_id", "error")) == [("m5", "no_posting_found"), ("m6", "empty_message")]
    due = E.to_reprocess(mails, jobs, failures, version=1)
    assert sorted(r["message_id"] for r in due.collect()) == ["m1", "m3", "m4", "m5", "m6"]
    assert E.to_reprocess(mails, jobs, failures, version=2).count() == 6


def test_language_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 200")
    found = docs.select("lang", E.language(F.col("text")).alias("found"))
    assert found.where("lang = found").count() >= 0.9 * found.count()
    none = spark.createDataFrame([("xyz 123",), (None,), ("",)], "t string")
    assert [r[0] for r in none.select(E.language(F.col("t"))).collect()] == [None, None, None]


def test_links_of_html_mail_are_kept(spark):
    mail = """<p>Cargo: Dev</p><div><a class="x" href="https://jobs.example.com/1?a=1&amp;b=2">Ver vaga</a></div>"""
    df = spark.createDataFrame([("m", "l", None, mail)], "message_id string, label string, raw_text string, raw_html string")
    text = df.select(E.message_text(F.col("raw_text"), F.col("raw_html"))).first()[0]
    assert "Ver vaga: https://jobs.example.com/1?a=1&b=2" in text
    sources = spark.createDataFrame([("l", "generic", 7)], "label string, parser string, source_id long")
    jobs = E.extract_jobs(df.withColumn("received_at", F.lit("2024-01-01").cast("timestamp")), sources)
    row = jobs.first()
    assert (row["url"], row["source_id"]) == ("https://jobs.example.com/1?a=1&b=2", 7)
    schemas.assert_contract(jobs, schemas.JOBS)
