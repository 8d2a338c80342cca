"""Attributes read from a posting's text: terms, work mode, seniority, contract, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.config import HYBRID, ON_SITE, REMOTE
from peneira.functions.once import computed, let
from peneira.functions.text import term_text, tokens
from peneira.operators.keyed import broadcast_if_bounded
from peneira.session import stage

MAX_BROADCAST_TERMS = 500_000
MAX_HEADS = 5_000

# Words that state a label, tried in this order on normalised text.
MODALITY_WORDS = (
    (HYBRID, "hibrido|hibrida|hybrid"),
    (REMOTE, "remoto|remota|remote|home office|teletrabalho"),
    (ON_SITE, "presencial|on site|onsite|in office"),
)
SENIORITY_WORDS = (
    ("Lead", "lead|lider|principal|staff"),
    ("Sênior", "senior|sr"),
    ("Pleno", "pleno|mid level|mid"),
    ("Júnior", "junior|jr"),
)
CONTRACT_WORDS = (
    ("CLT", "clt"),
    ("PJ", "pj|pessoa juridica|contractor"),
    ("Estágio", "estagio|internship"),
    ("Temporário", "temporario|temporary"),
)


def _first_label(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first table row whose words occur."""

    def pick(prepared: Column) -> Column:
        label = F.lit(None).cast("string")
        for name, words in reversed(table):
            label = F.when(prepared.rlike(f"(^| )({words})( |$)"), F.lit(name)).otherwise(label)
        return label

    return let(text, pick)


def posting_text(*columns: str) -> Column:
    return term_text(F.concat_ws(" | ", *[F.col(c) for c in columns]))


def modality(text: Column) -> Column:
    return _first_label(text, MODALITY_WORDS)


def seniority(text: Column) -> Column:
    return _first_label(text, SENIORITY_WORDS)


def contract(text: Column) -> Column:
    return _first_label(text, CONTRACT_WORDS)


def tag_modality(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("modality", modality(posting_text("title", "location", "description")))


def tag_seniority(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("seniority", seniority(posting_text("title", "description")))


def term_heads(dictionary: DataFrame) -> dict[int, list[str] | None]:
    """First words of the dictionary's terms by the number of words in a term.

    None in place of the words of a number that has more than MAX_HEADS of them.
    """
    words = F.split("term_norm", " ")
    heads = dictionary.where(F.col("term_norm").isNotNull()).select(F.size(words).alias("words"), words[0].alias("head")).distinct()
    heads = stage(heads, "heads")
    counts = {r["words"]: r["n"] for r in heads.groupBy("words").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [n for n in counts if counts[n] <= MAX_HEADS]
    found: dict[int, list[str] | None] = {n: [] if n in few else None for n in sorted(counts)}
    for r in heads.where(F.col("words").isin(few)).collect():
        found[r["words"]].append(r["head"])
    return found


def _runs(words: Column, n: int, heads: list[str] | None) -> Column:
    """Distinct runs of ``n`` words that begin with one of ``heads``; the others are no term and are not made."""
    whole = lambda i: i + n <= F.size(words)
    starts = (lambda w, i: whole(i)) if heads is None else (lambda w, i: w.isin(heads) & whole(i))
    run = (lambda w, i: w) if n == 1 else (lambda w, i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    return F.array_distinct(F.array_compact(F.transform(words, lambda w, i: F.when(starts(w, i), run(w, i)))))


def _hits(df: DataFrame, key: str, fields: dict[str, str], dictionary: DataFrame) -> DataFrame:
    """``key, field`` and the dictionary's columns: the terms in each named text column, once each.

    A run of words is made only where a term's first word stands, then looked up as a whole.
    """
    rows = computed(
        df.select(key, *set(fields.values())),
        **{f"_{name}": tokens(term_text(F.col(c))) for name, c in fields.items()},
    )
    heads = term_heads(dictionary)
    if not heads:
        return rows.select(key, F.lit("").alias("field"), F.lit("").alias("term_norm")).limit(0).join(dictionary, "term_norm")

    def entries(name: str) -> Column:
        runs = F.concat(*[_runs(F.col(f"_{name}"), n, words) for n, words in heads.items()])
        return F.transform(runs, lambda g: F.struct(F.lit(name).alias("field"), g.alias("term_norm")))

    found = rows.select(key, F.inline(F.concat(*map(entries, fields))))
    return found.join(broadcast_if_bounded(dictionary, MAX_BROADCAST_TERMS), "term_norm")


def term_dictionary(profile_terms: DataFrame) -> DataFrame:
    """Every term some profile names, once, and whether one names it as a technology."""
    return profile_terms.groupBy("term_norm").agg(
        F.max(F.col("dimension") == "technology").alias("is_technology")
    )


def tag_terms(jobs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary terms found per posting: ``job_id, terms, title_terms, technologies``.

    ``dictionary`` has the columns of ``term_dictionary``.

    Terms match as whole token runs by equality, so ``PHP`` does not match ``phpunit``; runs
    are as long as the dictionary's terms, whatever that is. While the dictionary can be
    broadcast only hits enter a shuffle, beyond that the runs do; the texts never.
    """
    return found_terms(term_hits(jobs, dictionary))


def term_hits(jobs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``job_id, field, term_norm, is_technology``: every term a posting's title or body holds."""
    return _hits(jobs, "job_id", {"title": "title", "body": "description"}, dictionary)


def found_terms(hits: DataFrame) -> DataFrame:
    """One row per posting of ``term_hits``: ``job_id, terms, title_terms, technologies``."""
    return hits.groupBy("job_id").agg(
        F.sort_array(F.collect_set("term_norm")).alias("terms"),
        F.sort_array(
            F.collect_set(F.when(F.col("field") == "title", F.col("term_norm")))
        ).alias("title_terms"),
        F.sort_array(
            F.collect_set(F.when(F.col("is_technology"), F.col("term_norm")))
        ).alias("technologies"),
    )


def location_dictionary(places: DataFrame) -> DataFrame:
    """(term_norm, key) rows from ``place, parent``: a place answers for itself and its parent."""
    own = places.select(term_text("place").alias("term_norm"), term_text("place").alias("key"))
    up = places.select(term_text("place").alias("term_norm"), term_text("parent").alias("key"))
    top = places.select(term_text("parent").alias("term_norm"), term_text("parent").alias("key"))
    return own.union(up).union(top).where("key != ''").distinct()


def tag_location(jobs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Places a posting answers for: ``job_id, location_keys``.

    A remote posting also answers for "remoto global" and "remoto <place>".
    """
    hits = _hits(jobs, "job_id", {"place": "location"}, dictionary)
    found = hits.groupBy("job_id").agg(F.collect_set("key").alias("found"))
    keys = F.coalesce("found", F.array().cast("array<string>"))
    remote = F.when(
        F.col("modality") == REMOTE,
        F.concat(
            F.array(F.lit("remoto global")),
            F.transform(keys, lambda k: F.concat(F.lit("remoto "), k)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return (
        jobs.select("job_id", "modality")
        .join(found, "job_id", "left")
        .select("job_id", F.array_sort(F.concat(keys, remote)).alias("location_keys"))
    )


def posting_facts(jobs: DataFrame) -> DataFrame:
    """What scoring needs of a posting besides its terms, read from its texts once."""
    whole = posting_text("title", "location", "description")
    body = posting_text("title", "description")
    return jobs.select(
        "job_id",
        "posted_at",
        "title",
        "company",
        "location",
        modality(whole).alias("modality"),
        seniority(body).alias("seniority"),
        contract(body).alias("contract"),
    )


def job_features(
    jobs: DataFrame, dictionary: DataFrame, places: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    """One narrow row per posting with everything scoring compares; no raw text.

    ``flags`` is a table of further per-posting columns to carry along, keyed by ``job_id``.
    """
    return features_of(posting_facts(jobs), tag_terms(jobs, dictionary), places, flags)


def features_of(
    facts: DataFrame, terms: DataFrame, places: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    """``job_features`` from ``posting_facts`` and the rows of ``tag_terms``, both perhaps stored."""
    places_found = tag_location(facts, location_dictionary(places))
    labels = F.filter(
        F.array(term_text("modality"), term_text("seniority")), lambda t: t.isNotNull()
    )
    none = F.array().cast("array<string>")
    narrow = facts.drop("location")
    carried = []
    if flags is not None:
        narrow = narrow.join(flags, "job_id", "left")
        carried = [c for c in flags.columns if c != "job_id"]
    return (
        narrow.join(terms, "job_id", "left")
        .join(places_found, "job_id", "left")
        .select(
            "job_id",
            "posted_at",
            term_text("company").alias("company_norm"),
            "modality",
            "seniority",
            "contract",
            *carried,
            F.coalesce("technologies", none).alias("technologies"),
            F.coalesce("title_terms", none).alias("title_terms"),
            F.coalesce("terms", none).alias("terms"),
            F.array_union(
                F.array_union(F.coalesce("terms", none), labels), F.coalesce("location_keys", none)
            ).alias("any_terms"),
            F.coalesce("location_keys", none).alias("location_keys"),
        )
    )
