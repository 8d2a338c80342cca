"""Profile, preference and evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira import schemas
from peneira.config import CV_SECTIONS, DEFAULTS, Weights
from peneira.functions.text import term_text
from peneira.operators.keyed import keep_first

# Scored dimensions: name, preference column, weight attribute.
_SCORED = (
    ("role", "roles", "role"),
    ("technology", "technologies", "technology"),
    ("seniority", "seniority", "seniority"),
    ("modality", "modalities", "modality"),
    ("location", "locations", "location"),
    ("required", "required", "required_bonus"),
)
_FILTERS = (
    ("company", "avoid_companies"),
    ("area", "avoid_areas"),
    ("contract", "contract_types"),
)
POSITIVE_DIMENSIONS = tuple(name for name, _, _ in _SCORED)


def load_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles with their preferences, both checked against their contracts."""
    profiles = schemas.assert_contract(
        spark.read.parquet(f"{folder}/profiles"), schemas.PROFILES
    )
    preferences = schemas.assert_contract(
        spark.read.parquet(f"{folder}/preferences"), schemas.PREFERENCES
    )
    return join_preferences(profiles, preferences)


def join_preferences(profiles: DataFrame, preferences: DataFrame) -> DataFrame:
    return profiles.join(preferences, "profile_id", "left")


def content_hash(df: DataFrame, ignore: tuple[str, ...] = ()) -> Column:
    kept = [F.col(c) for c in sorted(df.columns) if c not in ignore]
    return F.md5(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}))


def save_profiles(stored: DataFrame, edits: DataFrame, ts: str = "updated_at") -> DataFrame:
    """Stored rows with the last edit of each profile applied.

    The version rises by one only when the content differs, so an untouched save does not
    trigger rescoring. New profiles start at version 1.
    """
    ignore = ("version", ts)
    last = keep_first(edits.drop("version"), ["profile_id"], [F.desc(ts), F.desc(content_hash(edits, ignore))])
    last = last.withColumn("_hash", content_hash(last, (*ignore, "_hash")))
    current = stored.select(
        "profile_id", F.col("version").alias("_version"), content_hash(stored, ignore).alias("_stored_hash")
    )
    changed = (
        last.join(current, "profile_id", "left")
        .withColumn(
            "version",
            F.when(F.col("_version").isNull(), F.lit(1))
            .when(F.col("_hash") == F.col("_stored_hash"), F.col("_version"))
            .otherwise(F.col("_version") + 1),
        )
        .drop("_hash", "_stored_hash", "_version")
    )
    untouched = stored.join(last.select("profile_id"), "profile_id", "left_anti")
    return untouched.unionByName(changed)


def profile_terms(preferences: DataFrame, weights: Weights = DEFAULTS.weights) -> DataFrame:
    """Long form of the preferences: one row per (profile, dimension, normalised term).

    Rows are dealt out by their key before any of them is sorted: profiles are few bytes each, so one
    task reads many, and sorting their terms there would take memory for all of them.
    """

    def entries(dimension: str, column: str, weight: float, action: str) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.array().cast("array<string>")),
            lambda t: F.struct(
                F.lit(dimension).alias("dimension"),
                t.alias("term"),
                F.lit(weight).alias("weight"),
                F.lit(action).alias("action"),
            ),
        )

    parts = [entries(d, c, getattr(weights, w), "boost") for d, c, w in _SCORED]
    parts += [entries(d, c, 0.0, "discard") for d, c in _FILTERS]
    unwanted = F.transform(
        F.filter("unwanted", lambda u: u.isNotNull()),
        lambda u: F.struct(
            F.lit("unwanted").alias("dimension"),
            u["term"].alias("term"),
            F.lit(-weights.unwanted_penalty).alias("weight"),
            F.coalesce(u["action"], F.lit("penalize")).alias("action"),
        ),
    )
    parts.append(F.coalesce(unwanted, F.array().cast(
        "array<struct<dimension:string,term:string,weight:double,action:string>>")))
    return (
        preferences.select("profile_id", F.inline(F.concat(*parts)))
        .withColumn("term_norm", term_text(F.col("term")))
        .where("term_norm != ''")
        .repartition("profile_id", "dimension", "term_norm")
        .groupBy("profile_id", "dimension", "term_norm")
        .agg(
            F.min("term").alias("term"),
            F.min("weight").alias("weight"),
            F.min("action").alias("action"),
        )
        .select("profile_id", "dimension", "term", "term_norm", "weight", "action")
    )


def profile_features(profiles: DataFrame) -> DataFrame:
    """Wide form used by scoring: normalised term arrays per dimension, no shuffle."""

    def terms(column: Column) -> Column:
        clean = F.array_distinct(F.transform(column, lambda t: term_text(t)))
        return F.filter(
            F.coalesce(clean, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")
        )

    def unwanted(action: str) -> Column:
        chosen = F.filter(
            "unwanted", lambda u: F.coalesce(u["action"], F.lit("penalize")) == action
        )
        return terms(F.transform(chosen, lambda u: u["term"]))

    columns = {f"want_{d}": terms(F.col(c)) for d, c, _ in _SCORED}
    columns |= {f"avoid_{d}": terms(F.col(c)) for d, c in _FILTERS if d != "contract"}
    columns["want_contract"] = terms(F.col("contract_types"))
    columns["unwanted_discard"] = unwanted("discard")
    columns["unwanted_penalize"] = F.array_except(unwanted("penalize"), unwanted("discard"))
    return profiles.select(
        "profile_id", "version", "material_lang", "min_score", "max_age_days",
        *[c.alias(name) for name, c in columns.items()],
    )


def missing_cv_sections(profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """Profiles whose résumé data lacks a section, with the missing ones in listed order."""
    kinds = [s for s in CV_SECTIONS if s != "summary"]
    present = (
        evidence.where(F.col("kind").isin(kinds))
        .groupBy("profile_id")
        .agg(F.collect_set("kind").alias("present"))
    )
    has_summary = F.coalesce(F.trim("summary"), F.lit("")) != ""
    have = F.concat(
        F.coalesce("present", F.array().cast("array<string>")),
        F.when(has_summary, F.array(F.lit("summary"))).otherwise(F.array().cast("array<string>")),
    )
    return (
        profiles.select("profile_id", "summary")
        .join(present, "profile_id", "left")
        .select(
            "profile_id",
            F.array_except(F.array(*map(F.lit, CV_SECTIONS)), have).alias("missing_sections"),
        )
        .where(F.size("missing_sections") > 0)
    )
