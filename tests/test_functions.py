import datetime as dt

import pytest
from pyspark.sql import functions as F

from peneira.functions.dates import parse_date
from peneira.functions.html import html_to_text
from peneira.functions.links import canonical_url, host
from peneira.functions.text import norm, summarise, term_text, tokens


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [("  São   Paulo\n", "sao paulo"), ("AÇÃO Êxito", "acao exito"), ("", ""), (None, None)],
)
def test_norm(spark, text, expected):
    assert one(spark, text, norm) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Node.js, C++ e C#.", ["node.js", "c++", "e", "c#"]),
        ("Full-Stack (Sênior)", ["full", "stack", "senior"]),
        ("phpunit... PHP.", ["phpunit", "php"]),
        (" .NET ", [".net"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, text, lambda c: tokens(term_text(c))) == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a&amp;b</p><p>c &#233; &#xE9; &eacute;</p>", "a&b\nc é é é"),
        ("<script>var x='</p>';</script><!-- no --><b>x</b>  y<br/>z", "x y\nz"),
        ("&amp;lt; &unknown; & &#0;", "&lt; &unknown; & &#0;"),
        ("plain", "plain"),
    ],
)
def test_html_to_text(spark, html, expected):
    assert one(spark, html, html_to_text) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://Jobs.Example.com/View/1/?utm_source=a&jk=9#top", "https://jobs.example.com/View/1?jk=9"),
        ("https://e.com/x?b=2&a=1&REF=z", "https://e.com/x?a=1&b=2"),
        ("https://e.com/", "https://e.com"),
        ("https://e.com?jk=1", "https://e.com?jk=1"),
        ("no link", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, url, canonical_url) == expected


def test_host(spark):
    assert one(spark, "https://Www.E.com:80/x", host) == "www.e.com"
    assert one(spark, "x", host) is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-05", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("5 de março de 2024", "2024-03-05"),
        ("March 5, 2024", "2024-03-05"), ("hoje", "2024-06-10"), ("ontem", "2024-06-09"),
        ("há 3 dias", "2024-06-07"), ("2 weeks ago", "2024-05-27"), ("há 5 horas", "2024-06-10"),
        ("em breve", "2024-06-10"), ("31/02/2024", "2024-06-10"), (None, "2024-06-10"),
    ],
)
def test_parse_date(spark, text, expected):
    received = F.lit("2024-06-10 09:00:00").cast("timestamp")
    assert one(spark, text, lambda c: parse_date(c, received)) == dt.date.fromisoformat(expected)


def test_summarise_cuts_after_a_sentence(spark):
    assert one(spark, "Um. Dois. Três longo", lambda c: summarise(c, 12)) == "Um. Dois."
    assert one(spark, "curto", lambda c: summarise(c, 12)) == "curto"
    assert one(spark, "semponto" * 4, lambda c: summarise(c, 8)) == "semponto"
