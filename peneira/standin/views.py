"""Sources, alert mails, postings, profiles and evidence derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.functions.text import term_text
from peneira.operators.extract import language

# The two word lists part names are made of.
FIRST_WORDS = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
SECOND_WORDS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
AS_OF = "2001-09-01"
PARSERS = ("linkedin", "indeed", "generic")

_EMPTY = "cast(array() as array<string>)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(words: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"element_at(array({listed}), cast(pmod({index}, 8) as int) + 1)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: one source per distinct document source; even numbers are active."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_documents"))
        .select(
            n.alias("source_id"),
            F.concat(F.lit("Fonte "), "source").alias("name"),
            F.col("source").alias("label"),
            F.lit(None).cast("string").alias("label_id"),
            F.when(n % 2 == 0, "active").otherwise("inactive").alias("status"),
            F.element_at(F.array(*map(F.lit, PARSERS)), (n % 3 + 1).cast("int")).alias("parser"),
            F.lit(None).cast("timestamp").alias("last_sync_at"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        )
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: every document as one stored message of its source's label."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("message_id"),
        F.col("source").alias("label"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("received_at"),
        F.lit(None).cast("string").alias("subject"),
        F.lit(None).cast("string").alias("sender"),
        F.col("text").alias("raw_text"),
        F.lit(None).cast("string").alias("raw_html"),
        F.lit("new").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: every page as an HTML message."""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("message_id"),
        F.concat(F.lit("src"), F.col("page_id") % 20).alias("label"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("received_at"),
        F.lit(None).cast("string").alias("raw_text"),
        F.col("html").alias("raw_html"),
        "url",
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: every event as one arrival; ids repeat, so duplicates are real."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", "user_id", "event_type", F.floor("value")).alias("message_id"),
        F.col("event_type").alias("label"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("event_id").alias("arrival_no"),
        F.col("props").alias("raw_text"),
    )


def _label(column: str, table_: dict[str, str | None]) -> Column:
    out = F.lit(None).cast("string")
    for value, label in table_.items():
        out = F.when(F.col(column) == value, F.lit(label).cast("string")).otherwise(out)
    return out


# What the stand-in reads into part types.
LEVEL_OF_TYPE = {
    "ECONOMY": "Júnior", "STANDARD": "Pleno", "MEDIUM": "Sênior", "LARGE": "Lead",
    "SMALL": "Estágio",
}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J: every part with its order as one posting.

    Level, work mode and contract stand only in the description, so they must be read out
    of the text. Some rows lack a company, a date or a link.
    """
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    nation = table(spark, sf_dir, "nation")
    key = F.col("p_partkey")
    mail = F.floor(key / 3)
    level = _label("p_type", LEVEL_OF_TYPE)
    mode = (
        F.when(F.col("p_size") % 4 == 0, "Remoto")
        .when(F.col("p_size") % 4 == 1, "Híbrido")
        .when(F.col("p_size") % 4 == 2, "Presencial")
    )
    agreement = F.when(key % 3 == 0, "CLT").when(key % 3 == 1, "PJ")
    description = F.concat(
        F.lit("Buscamos "), "p_name",
        F.coalesce(F.concat(F.lit(" "), level), F.lit("")), F.lit("."),
        F.coalesce(F.concat(F.lit(" Regime "), mode, F.lit(".")), F.lit("")),
        F.coalesce(F.concat(F.lit(" Contrato "), agreement, F.lit(".")), F.lit("")),
    )
    url = F.when(
        F.col("p_size") != 19,
        F.concat(
            F.lit("HTTP://Jobs.Example.com/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"),
            F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), "p_type",
            F.lit("/?utm_source=src"), key % 20, F.lit("#top"),
        ),
    )
    return (
        part.join(orders, F.col("o_orderkey") == key)
        .join(nation, F.col("n_nationkey") == key % 25)
        .select(
            F.concat(F.lit("j"), key).alias("job_id"),
            F.concat(F.lit("m"), mail).alias("message_id"),
            (key % 3 + 1).cast("int").alias("block_no"),
            (mail % 20).cast("long").alias("source_id"),
            F.col("p_name").alias("title"),
            F.when(F.col("p_size") != 13, F.col("p_brand")).alias("company"),
            F.col("n_name").alias("location"),
            url.alias("url"),
            description.alias("description"),
            F.when(F.col("p_size") != 17, F.col("o_orderdate").cast("date")).alias("posted_at"),
            language(F.concat_ws(" ", "p_name", description)).alias("lang"),
            F.col("o_orderdate").cast("timestamp").alias("extracted_at"),
        )
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place hierarchy: nation under region."""
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("place"), F.col("r_name").alias("parent"))
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: every customer as a profile with preferences computed from its key and segment."""
    first, second = (lambda i: _word(FIRST_WORDS, i)), (lambda i: _word(SECOND_WORDS, i))
    role = f"concat({first('k')}, ' ', {second('k div 8')})"
    other_role = f"concat({first('k + 3')}, ' ', {second('k div 8 + 5')})"
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .withColumn("k", F.col("c_custkey"))
        .selectExpr(
            "k as profile_id",
            "c_name as full_name",
            "concat('perfil', k, '@example.com') as email",
            f"case when k % 5 = 0 then 'pessoa candidata' else {role} end as current_role",
            "n_name as location",
            "'pt' as ui_lang",
            "case k % 3 when 1 then 'pt' when 2 then 'en' end as material_lang",
            "case when k % 10 = 0 then null else concat('Atua com ', lower(c_mktsegment)) end as summary",
            "cast(1 + k % 3 as int) as version",
            f"""case when k % 5 = 0 then {_EMPTY} when k % 3 = 0 then array({role}, {other_role})
                else array({role}) end as roles""",
            """case c_mktsegment when 'BUILDING' then array('Pleno', 'Sênior')
                when 'AUTOMOBILE' then array('Júnior') when 'MACHINERY' then array('Sênior', 'Lead')
                when 'HOUSEHOLD' then array('Pleno') else cast(array() as array<string>) end as seniority""",
            f"""case when k % 7 = 0 then {_EMPTY} else array({first('k div 2')},
                {second('k div 16')}, {second('k div 16 + 3')}) end as technologies""",
            f"""case k % 4 when 0 then array('Remoto') when 1 then array('Remoto', 'Híbrido')
                when 2 then array('Presencial') else {_EMPTY} end as modalities""",
            f"""case k % 6 when 0 then {_EMPTY} when 1 then array(r_name)
                when 2 then array(n_name, 'Remoto global') else array(n_name) end as locations""",
            f"""case k % 4 when 1 then array({second('k div 4')})
                when 2 then array({first('k div 4')}, 'Remoto') else {_EMPTY} end as required""",
            f"""case k % 3
                when 0 then array(named_struct('term', {first('k + 5')}, 'action', 'penalize'))
                when 1 then array(named_struct('term', {second('k + 6')}, 'action', 'discard'),
                                  named_struct('term', 'Estágio', 'action', 'penalize'))
                else cast(array() as array<struct<term:string,action:string>>) end as unwanted""",
            f"case when k % 5 = 2 then array(concat('Brand#', k % 25 + 1)) else {_EMPTY} end as avoid_companies",
            f"case when k % 11 = 0 then array({second('k div 11')}) else {_EMPTY} end as avoid_areas",
            f"{_EMPTY} as interest_areas",
            f"""case k % 6 when 3 then array('PJ') when 4 then array('CLT', 'PJ')
                else {_EMPTY} end as contract_types""",
            "cast(c_acctbal as decimal(12,2)) as salary_expectation",
            "cast(60 + 5 * (k % 5) as int) as min_score",
            "case when k % 4 = 0 then null else cast(365 * (1 + k % 6) as int) end as max_age_days",
        )
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered facts: two skills per profile, other résumé sections for most."""
    k = F.col("c_custkey")

    def fact(kind: str, name: str, level: str, keep: str) -> Column:
        return F.when(
            F.expr(keep),
            F.struct(
                F.lit(kind).alias("kind"), F.expr(name).alias("name"), F.expr(level).alias("level")
            ),
        )

    facts = F.array(
        fact("skill", _word(FIRST_WORDS, "c_custkey div 2"), "'Avançado'", "true"),
        fact("skill", _word(SECOND_WORDS, "c_custkey div 16"), "'Intermediário'", "true"),
        fact("experience", _word(SECOND_WORDS, "c_custkey div 16 + 3"), "'Sênior'", "c_custkey % 9 != 0"),
        fact("project", "concat('Projeto ', lower(c_mktsegment))", "null", "true"),
        fact("education", "'Graduação'", "null", "c_custkey % 13 != 0"),
        fact("certification", "concat('Certificação ', c_nationkey)", "null", "true"),
        fact("language", "'Português'", "'Nativo'", "true"),
    )
    return (
        table(spark, sf_dir, "customer")
        .select(k.alias("profile_id"), F.inline(F.filter(facts, lambda f: f.isNotNull())))
        .select(
            "profile_id",
            "kind",
            "name",
            term_text("name").alias("name_norm"),
            "level",
            ((F.col("profile_id") % 10) / 2).alias("years"),
            F.concat(F.lit("Uso de "), "name", F.lit(" em projetos reais")).alias("evidence"),
        )
    )


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: alert mails of up to three postings each, in their source's layout.

    Even-numbered generic mails come as HTML only.
    """
    j = jobs(spark, sf_dir)
    blank = F.lit("")

    def line(prefix: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit("\n" + prefix), value), blank)

    day = F.to_date(F.lit(AS_OF))
    stated = (
        F.when(F.col("block_no") == 1, F.date_format("posted_at", "yyyy-MM-dd"))
        .when(F.col("block_no") == 2, F.date_format("posted_at", "dd/MM/yyyy"))
        .otherwise(F.concat(F.lit("há "), F.datediff(day, "posted_at"), F.lit(" dias")))
    )
    company = F.coalesce("company", blank)
    linkedin = F.concat(
        "title", F.lit("\n"), company, F.lit("\n"), "location", F.lit("\n"), "description",
        line("Publicada: ", stated), line("Ver vaga: ", F.col("url")),
    )
    indeed = F.concat(
        "title", F.lit("\n"), company, F.lit(" - "), "location", F.lit("\n"), "description",
        line("Publicado em ", stated), line("", F.col("url")),
    )
    generic = F.concat(
        F.lit("Cargo: "), "title", line("Empresa: ", F.col("company")), line("Local: ", F.col("location")),
        line("Descrição: ", F.col("description")), line("Data: ", stated), line("Link: ", F.col("url")),
    )
    parser = F.col("source_id") % 3
    card = F.when(parser == 0, linkedin).when(parser == 1, indeed).otherwise(generic)
    cards = F.transform(
        F.array_sort(F.collect_list(F.struct("block_no", card.alias("card")))), lambda c: c["card"]
    )
    as_html = (parser == 2) & (F.expr("cast(substr(message_id, 2) as long)") % 2 == 0)
    body = F.array_join("cards", "\n------\n")
    escaped = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("<br/>\n"))
    html = F.concat(
        F.lit("<html><head><style>p{margin:0}</style></head><body><div>"),
        F.regexp_replace(escaped, r"Link: ([^\s<]+)", '<a class="b" href="$1">Link</a>'),
        F.lit("</div></body></html>"),
    )
    # At most three postings share a message id, so each group is three cards.
    return (
        j.groupBy("message_id", "source_id")
        .agg(cards.alias("cards"))
        .select(
            "message_id",
            F.concat(F.lit("src"), "source_id").alias("label"),
            F.lit(f"{AS_OF} 08:00:00").cast("timestamp").alias("received_at"),
            F.when(~as_html, body).alias("raw_text"),
            F.when(as_html, html).alias("raw_html"),
        )
    )
