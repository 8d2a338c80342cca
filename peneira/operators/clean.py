"""Duplicates, stale and incompatible postings, and the status they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.config import DEFAULTS
from peneira.functions.links import canonical_url
from peneira.functions.once import computed
from peneira.functions.text import norm, term_text
from peneira.operators.extract import missing_fields
from peneira.operators.groups import dup_groups
from peneira.operators.keyed import keep_first, present, spread_lookup
from peneira.session import stage

# Posting states, the first that applies wins.
STATUSES = ("extraction_failed", "duplicate", "stale", "incompatible", "active")


def dup_by_key(jobs: DataFrame, keys: Sequence[str], name: str = "dup_of") -> DataFrame:
    """Postings with the id of the earliest one sharing all key values, null for that one.

    A null key value never makes a duplicate. The earliest per key is found with one row
    per key and task shuffled; the way back deals keys that many postings share, and postings
    without a key, over several tasks.
    """
    first = keep_first(
        jobs.where(present(keys)).select(*keys, "posted_at", "job_id"),
        keys,
        [F.asc_nulls_last("posted_at"), F.col("job_id")],
    ).select(*keys, F.col("job_id").alias("_first"))
    return (
        spread_lookup(jobs, first, keys, F.col("job_id"))
        .withColumn(name, F.when(F.col("_first") != F.col("job_id"), F.col("_first")))
        .drop("_first")
    )


CONTENT_KEYS = ("company", "title", "location")


def duplicate_links(jobs: DataFrame) -> DataFrame:
    """``id_a, id_b``: postings that share a canonical link, or company, title and location."""
    keyed = stage(
        jobs.select(
            "job_id", "posted_at", canonical_url(F.col("url")).alias("canonical_url"), *[norm(F.col(c)).alias(c) for c in CONTENT_KEYS]
        ),
        "duplicate-keys",
    )
    found = [dup_by_key(keyed, keys).where("dup_of is not null").select(F.col("job_id").alias("id_a"), F.col("dup_of").alias("id_b"))
             for keys in (["canonical_url"], list(CONTENT_KEYS))]
    return found[0].unionByName(found[1])


def flag_jobs(jobs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Postings with ``missing_fields``, ``failed``, ``dup_of`` and ``newest_at``.

    Postings joined by duplicate links, directly or over others, are one group; ``links`` adds
    further ones (``id_a, id_b``, as of near-equal texts). The group shows its earliest posting
    that is not failed, and all others name it in ``dup_of``. ``newest_at`` is the latest
    date in the group: a posting put up again is as fresh as its last copy.
    """
    marked = jobs.withColumns({"canonical_url": canonical_url(F.col("url")), "missing_fields": missing_fields()})
    marked = marked.withColumn("failed", failed())
    pairs = duplicate_links(jobs)
    if links is not None:
        pairs = pairs.unionByName(links.select("id_a", "id_b"))
    groups = stage(dup_groups(pairs).select(F.col("id").alias("job_id"), "group_id"), "duplicate-groups")
    members = groups.join(marked.select("job_id", "failed", "posted_at"), "job_id")
    shown = F.min(F.struct("failed", F.col("posted_at").isNull().alias("undated"), "posted_at", "job_id"))
    heads = members.groupBy("group_id").agg(shown["job_id"].alias("_head"), F.max("posted_at").alias("_newest"))
    known = groups.join(heads, "group_id").drop("group_id")
    return (
        marked.join(known, "job_id", "left")
        .withColumn("dup_of", F.when(F.col("_head") != F.col("job_id"), F.col("_head")))
        .withColumn("newest_at", F.coalesce("_newest", "posted_at"))
        .drop("_head", "_newest")
    )


def job_flags(jobs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``job_id, failed, dup_of, newest_at``: what triage needs to know of a posting's cleaning."""
    return flag_jobs(jobs, links).select("job_id", "failed", "dup_of", "newest_at")


def failed(required: Sequence[str] = DEFAULTS.required_fields) -> Column:
    """Whether a field without which a posting is of no use is missing."""
    return F.arrays_overlap("missing_fields", F.array(*map(F.lit, required)))


def age_days(as_of: Column) -> Column:
    """Days since the latest copy of the posting went up."""
    return F.datediff(as_of, "newest_at")


def stale(as_of: Column, default_max_age: int = DEFAULTS.max_age_days) -> Column:
    """Whether a posting is older than the profile accepts; undated ones are not stale."""
    limit = F.coalesce("max_age_days", F.lit(default_max_age))
    return F.coalesce(age_days(as_of) > limit, F.lit(False))


def incompatible_reasons() -> Column:
    """Basic filters a scored pair breaks: discard terms, avoided company, contract type."""
    terms = F.transform(
        F.filter("discard", lambda f: F.array_contains("features", f)),
        lambda f: F.concat(F.lit("term: "), F.substr(f, F.lit(6))),
    )
    none = F.array().cast("array<string>")
    company = F.when(
        F.array_contains("avoid_company", F.col("company_norm")),
        F.array(F.concat(F.lit("company: "), "company_norm")),
    ).otherwise(none)
    agreed = term_text("contract")
    contract = F.when(
        (F.size("want_contract") > 0) & agreed.isNotNull() & ~F.array_contains("want_contract", agreed),
        F.array(F.concat(F.lit("contract: "), agreed)),
    ).otherwise(none)
    return F.array_sort(F.concat(terms, company, contract))


def flag_pairs(pairs: DataFrame, as_of: Column, apart: bool = False) -> DataFrame:
    """Pairs with stale and incompatible flags; reads only columns the pair already has.

    Where the pairs are those left of many more, the reasons are kept ``apart``: a later filter on
    them or on the status is then not asked of the many.
    """
    if apart:
        return computed(pairs.withColumn("stale", stale(as_of)), incompatible=incompatible_reasons())
    return pairs.withColumns(
        {"stale": stale(as_of), "incompatible": incompatible_reasons()}
    )


def resolve_status(flagged: DataFrame) -> DataFrame:
    """One visible status per pair, with every reason that applies."""
    conditions = (
        F.col("failed"),
        F.col("dup_of").isNotNull(),
        F.col("stale"),
        F.size("incompatible") > 0,
    )
    status = F.lit(STATUSES[-1])
    for name, holds in reversed(list(zip(STATUSES, conditions, strict=False))):
        status = F.when(holds, F.lit(name)).otherwise(status)
    reasons = F.filter(
        F.array(*[F.when(h, F.lit(n)) for n, h in zip(STATUSES, conditions, strict=False)]),
        lambda r: r.isNotNull(),
    )
    return flagged.withColumns({"status": status, "reasons": reasons})


def latest_jobs(jobs: DataFrame, key: str = "job_id", ts: str = "extracted_at", tie: str = "message_id") -> DataFrame:
    """Last extracted version per posting; earlier messages stay in the message store."""
    return keep_first(jobs, [key], [F.desc(ts), F.desc(tie)])


def job_lineage(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """Audit trail: one row per (group, posting, message) that mentioned it.

    ``members`` maps ``job_id`` to ``group_id``. Rows, not one list per group: a group may
    hold much of the data.
    """
    return members.join(mentions.select("job_id", "message_id", "received_at"), "job_id").select(
        "group_id", "job_id", "message_id", "received_at"
    )


def lineage_summary(lineage: DataFrame) -> DataFrame:
    """First and last mention and number of postings and messages per group."""
    return lineage.groupBy("group_id").agg(
        F.min("received_at").alias("first_seen"),
        F.max("received_at").alias("last_seen"),
        F.count_distinct("job_id").alias("n_jobs"),
        F.count_distinct("message_id").alias("n_messages"),
    )
