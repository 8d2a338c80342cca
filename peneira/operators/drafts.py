"""Support drafts for strong pairs, assembled from registered facts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.config import DEFAULTS, MATERIAL_KINDS
from peneira.operators.keyed import keep_first

# Draft templates per kind and language. Fields are filled from the profile,
# its registered facts and the posting; nothing else is ever written.
TEMPLATES: dict[tuple[str, str], str] = {
    ("cv", "pt"): "{full_name}\n{current_role}\n{profile_summary}\nRelevante para {title}:\n{facts}",
    ("cv", "en"): "{full_name}\n{current_role}\n{profile_summary}\nRelevant to {title}:\n{facts}",
    ("letter", "pt"): "Prezada equipe {company},\nTenho interesse na vaga {title}. Meus fatos registrados:\n{facts}\n{full_name}",
    ("letter", "en"): "Dear {company} team,\nI am interested in the {title} position. My registered facts:\n{facts}\n{full_name}",
    ("summary", "pt"): "{title} - {company} - {location}\nScore {score} ({classification})\n{reason}",
    ("summary", "en"): "{title} - {company} - {location}\nScore {score} ({classification})\n{reason}",
    ("highlights", "pt"): "Destaque na candidatura:\n{top_facts}",
    ("highlights", "en"): "Highlight in your application:\n{top_facts}",
}
LANGUAGES = tuple(sorted({lang for _, lang in TEMPLATES}))
# Kinds that carry facts, and the column holding the ones they use.
_FACT_COLUMN = {"cv": "facts", "letter": "facts", "highlights": "top_facts"}


def eligible(triaged: DataFrame, cutoff: int = DEFAULTS.draft_cutoff) -> DataFrame:
    """Active pairs from the draft cut-off on: nothing is drafted for a hidden posting."""
    return triaged.where((F.col("score") >= cutoff) & (F.col("status") == "active"))


def ready(pairs: DataFrame, missing: DataFrame) -> DataFrame:
    """Pairs of profiles whose résumé data is complete."""
    return pairs.join(missing.select("profile_id"), "profile_id", "left_anti")


def fact_id() -> Column:
    return F.concat_ws(":", "kind", "name_norm")


def match_evidence(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pairs with ``facts``: registered facts the posting asks for, most relevant first.

    A profile's facts are gathered once and joined as one row, so pairs are not multiplied.
    Order: skills and experience met by a wish, then longer experience, then id.
    """
    fact = F.struct(
        (-F.coalesce("years", F.lit(0.0))).alias("order"),
        fact_id().alias("fact_id"),
        "name", "name_norm", "level", "evidence",
    )
    registered = evidence.groupBy("profile_id").agg(
        F.array_sort(F.collect_list(fact)).alias("registered")
    )
    matched = F.filter(
        "registered",
        lambda r: F.array_contains("features", F.concat(F.lit("term:"), r["name_norm"])),
    )
    return pairs.join(registered, "profile_id").withColumn("facts", matched).drop("registered")


def evidence_rows(matched: DataFrame) -> DataFrame:
    """Matched facts, one row each."""
    return matched.select("profile_id", "job_id", F.posexplode("facts").alias("position", "f")).select(
        "profile_id", "job_id", (F.col("position") + 1).alias("position"), F.col("f.fact_id").alias("fact_id"),
        F.col("f.name").alias("name"), F.col("f.level").alias("level"), F.col("f.evidence").alias("evidence"),
    )


def highlights(matched: DataFrame, k: int) -> DataFrame:
    """The k most relevant matched facts per pair."""
    return evidence_rows(matched.withColumn("facts", F.slice("facts", 1, k)))


def pick_lang(profile_lang: Column, job_lang: Column, default: str = DEFAULTS.default_lang) -> Column:
    """The profile's setting, else the posting's language, else the default."""
    known = F.when(job_lang.isin(*LANGUAGES), job_lang)
    return F.coalesce(F.when(profile_lang.isin(*LANGUAGES), profile_lang), known, F.lit(default))


def _fact_lines(facts: str) -> Column:
    return F.array_join(
        F.transform(
            facts,
            lambda f: F.concat(
                F.lit("- "), f["name"], F.coalesce(F.concat(F.lit(" ("), f["level"], F.lit(")")), F.lit("")),
                F.lit(": "), f["evidence"],
            ),
        ),
        "\n",
    )


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Template text and field values, alternating; a value is never scanned for fields."""
    parts: list[Column] = []
    for chunk in template.replace("}", "{").split("{"):
        if chunk in values:
            parts.append(F.coalesce(values[chunk].cast("string"), F.lit("")))
        elif chunk:
            parts.append(F.lit(chunk))
    return F.concat(*parts)


def render(matched: DataFrame, created_at: Column, k: int = 3) -> DataFrame:
    """The four drafts of every pair, as rows of the materials table.

    ``matched`` has the pair's facts, reason and the profile and posting fields named in the
    templates. Drafts that live from facts are left out where no fact matches.
    """
    rows = matched.withColumn("top_facts", F.slice("facts", 1, k))
    values = {c: F.col(c) for c in (
        "full_name", "current_role", "profile_summary", "title", "company", "location", "score",
        "classification", "reason",
    )} | {"facts": _fact_lines("facts"), "top_facts": _fact_lines("top_facts")}
    drafts = []
    for kind in MATERIAL_KINDS:
        body = F.lit(None).cast("string")
        for lang in LANGUAGES:
            body = F.when(F.col("lang") == lang, _fill(TEMPLATES[kind, lang], values)).otherwise(body)
        if kind in _FACT_COLUMN:
            used = F.transform(_FACT_COLUMN[kind], lambda f: f["fact_id"])
        else:
            used = F.array().cast("array<string>")
        draft = F.struct(F.lit(kind).alias("kind"), body.alias("body"), used.alias("facts_used"))
        drafts.append(F.when(F.size("facts") > 0, draft) if kind in _FACT_COLUMN else draft)
    listed = F.filter(F.array(*drafts), lambda d: d.isNotNull())
    return rows.select("profile_id", "job_id", "lang", F.inline(listed)).select(
        "profile_id", "job_id", "kind", "lang", "body", "facts_used",
        created_at.cast("timestamp").alias("created_at"),
    )


def ungrounded(materials: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts a draft uses that its profile has not registered; must be empty."""
    used = materials.select("profile_id", "job_id", "kind", F.explode("facts_used").alias("fact_id"))
    registered = evidence.select("profile_id", fact_id().alias("fact_id"))
    return used.join(registered, ["profile_id", "fact_id"], "left_anti")


def latest_materials(materials: DataFrame) -> DataFrame:
    """Newest draft per profile, posting and kind."""
    return keep_first(
        materials, ["profile_id", "job_id", "kind"], [F.desc("created_at"), F.desc("lang"), F.desc("body")]
    )
