"""Deterministic 0-100 score of profile-posting pairs, with its explanation.

Pairs come from an inverted-index join on terms, never from a cross product. A profile is
looked up only by terms without which its minimum score cannot be reached, so the join
meets a small share of all pairs and still returns every pair at or above that score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.config import APPLY, DEFAULTS, IGNORE, REVIEW, Settings, Weights
from peneira.functions.once import computed
from peneira.functions.text import term_text
from peneira.operators.keyed import hot_keys, salted_join, tasks_for

ROUNDING_SLACK = 0.5 + 1e-9

# dimension -> prefix of the posting feature it is compared with
_FEATURE = {
    "role": "role",
    "technology": "term",
    "seniority": "seniority",
    "modality": "modality",
    "location": "location",
    "required": "term",
}
_ANY_OF = ("role", "seniority", "modality", "location")
DIMENSIONS = ("role", "technology", "seniority", "modality", "location")


def _prefixed(prefix: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(f"{prefix}:"), t))


def _one(prefix: str, label: Column) -> Column:
    term = term_text(label)
    return F.when(term.isNotNull(), F.array(F.concat(F.lit(f"{prefix}:"), term))).otherwise(
        F.array().cast("array<string>")
    )


def _codes(features: Column) -> Column:
    """Features as 64-bit hashes: what joins, bounds and shares compare."""
    return F.transform(features, lambda f: F.xxhash64(f))


def _signatures(codes: Column) -> tuple[Column, Column]:
    """Two 64-bit signatures of a code set: each code sets one bit in either."""

    def fold(offset: int) -> Column:
        return F.aggregate(
            codes,
            F.lit(0).cast("long"),
            lambda seen, code: seen.bitwiseOR(
                F.call_function(
                    "shiftleft",
                    F.lit(1).cast("long"),
                    F.pmod(F.shiftright(code, offset), F.lit(64)).cast("int"),
                )
            ),
        )

    return fold(0), fold(6)


def posting_features(job_features: DataFrame) -> DataFrame:
    """Posting row with one array holding every feature a preference can match."""
    flags = [c for c in ("failed", "dup_of", "newest_at") if c in job_features.columns]
    rows = job_features.select(
        "job_id",
        "posted_at",
        "company_norm",
        "contract",
        "modality",
        "technologies",
        *flags,
        F.array_distinct(
            F.concat(
                _prefixed("role", F.col("title_terms")),
                _prefixed("term", F.col("any_terms")),
                _one("seniority", F.col("seniority")),
                _one("modality", F.col("modality")),
                _prefixed("location", F.col("location_keys")),
            )
        ).alias("features"),
    )
    coded = rows.withColumn("codes", _codes(F.col("features")))
    first, second = _signatures(F.col("codes"))
    return coded.withColumns({"signature_1": first, "signature_2": second})


def scoring_profiles(profile_features: DataFrame, weights: Weights = DEFAULTS.weights) -> DataFrame:
    """Profile row with its wishes as posting features and its total weight."""
    total = F.lit(0.0)
    for d in DIMENSIONS:
        total = total + F.when(F.size(f"want_{d}") > 0, F.lit(getattr(weights, d))).otherwise(0.0)
    wanted = {d: _prefixed(p, F.col(f"want_{d}")).alias(f"want_{d}") for d, p in _FEATURE.items()}
    others = [
        c for c in profile_features.columns if c not in {f"want_{d}" for d in _FEATURE}
        and c not in ("unwanted_penalize", "unwanted_discard", "avoid_area")
    ]
    rows = profile_features.select(
        *others,
        *wanted.values(),
        _prefixed("term", F.col("unwanted_penalize")).alias("unwanted_penalize"),
        _prefixed("term", F.array_union("unwanted_discard", "avoid_area")).alias("discard"),
        total.alias("total_weight"),
    )
    codes = {f"code_{d}": _codes(F.col(f"want_{d}")) for d in _FEATURE}
    codes["code_unwanted"] = _codes(F.col("unwanted_penalize"))
    masks = {}
    for d in _FEATURE:
        masks[f"mask_1_{d}"], masks[f"mask_2_{d}"] = _signatures(F.col(f"code_{d}"))
    return rows.withColumns(codes).withColumns(masks)


def feature_counts(postings: DataFrame) -> DataFrame:
    """Number of postings per feature code."""
    return (
        postings.select(F.explode("codes").alias("code"))
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("n_postings"))
    )


def _full_points(d: str, weights: Weights) -> Column:
    """Points a pair gets from a dimension it meets in full."""
    if d == "required":
        return F.lit(weights.required_bonus)
    return F.lit(100.0 * getattr(weights, d)) / F.col("total_weight")


def score_bound(weights: Weights = DEFAULTS.weights) -> Column:
    """Upper bound of a pair's score from signatures alone, in a few long operations.

    A wish the posting meets has its bit set in both signatures. Wishes of one profile that
    share a bit are all counted, so the bound is never below the score.
    """
    bound = F.lit(0.0)
    for d in _FEATURE:
        wishes = F.size(f"want_{d}")
        masks = [F.col(f"mask_{i}_{d}") for i in (1, 2)]
        common = [m.bitwiseAND(F.col(f"signature_{i}")) for i, m in enumerate(masks, start=1)]
        if d in _ANY_OF:
            part = F.when((common[0] != 0) & (common[1] != 0), _full_points(d, weights)).otherwise(0.0)
        else:
            met = F.least(
                *[F.bit_count(c) + wishes - F.bit_count(m) for c, m in zip(common, masks, strict=True)]
            )
            part = F.when(wishes > 0, _full_points(d, weights) * met / wishes).otherwise(0.0)
        bound = bound + part
    return bound


def probe_features(
    profiles: DataFrame, counts: DataFrame, threshold: Column, weights: Weights = DEFAULTS.weights
) -> DataFrame:
    """Per profile the features a pair must share one of to reach ``threshold``.

    A profile's features are taken from the most to the least common, adding up the most
    each can contribute. As long as the sum stays below the threshold, a pair matching only
    those features cannot reach it, so they need not be looked up. Features no posting has
    are left out: they cannot contribute.
    """

    def worth(d: str) -> Column:
        points = _full_points(d, weights)
        if d not in _ANY_OF:
            points = points / F.size(f"want_{d}")
        return F.transform(
            f"code_{d}", lambda code: F.struct(code.alias("code"), points.alias("points"))
        )

    listed = profiles.select(
        "profile_id",
        threshold.alias("threshold"),
        F.inline(
            F.concat(
                *[F.when(F.size(f"want_{d}") > 0, worth(d)).otherwise(
                    F.array().cast("array<struct<code:bigint,points:double>>")
                ) for d in _FEATURE]
            )
        ),
    )
    worths = listed.groupBy("profile_id", "threshold", "code").agg(F.sum("points").alias("points"))
    order = Window.partitionBy("profile_id").orderBy(F.desc("n_postings"), "code")
    return (
        worths.join(counts, "code")
        .withColumn("reach", F.sum("points").over(order))
        .where(F.col("reach") >= F.col("threshold") - ROUNDING_SLACK)
        .select("profile_id", "code", "n_postings")
    )


def candidate_pairs(
    postings: DataFrame,
    profiles: DataFrame,
    probes: DataFrame,
    counts: DataFrame,
    threshold: Column,
    weights: Weights = DEFAULTS.weights,
    admitted: Column | None = None,
) -> DataFrame:
    """Pairs that share a looked-up feature and whose score bound reaches ``threshold``.

    ``admitted`` is a cheap condition on both sides that is asked first, as of a posting's age.

    With the probes of threshold 0 these are all pairs sharing any positive term; every
    other pair scores exactly 0. A pair appears once per looked-up feature it shares;
    ``with_shares`` keeps it at the first of them, so no distinct over the pairs is needed.
    """
    per_profile = probes.groupBy("profile_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("n_postings", "code"))), lambda s: s["code"]
        ).alias("probes")
    )
    wanting = profiles.join(per_profile, "profile_id").withColumn("code", F.explode("probes"))
    wanted = probes.groupBy("code").agg(F.count(F.lit(1)).alias("n_right"))
    sizes = wanted.join(counts.withColumnRenamed("n_postings", "n_left"), "code")
    offered = postings.withColumn("code", F.explode("codes"))
    # The output is far larger than the input, which size-based planning cannot see.
    least = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = sizes.agg(F.sum(F.col("n_left").cast("double") * F.col("n_right"))).first()[0] or 0.0
    partitions, per_cell = tasks_for(work, least)
    pairs = salted_join(
        offered, wanting, ["code"], F.col("job_id"), F.col("profile_id"),
        hot_keys(sizes, ["code"], per_cell), partitions,
    )
    if admitted is not None:
        pairs = pairs.where(admitted)
    return pairs.where(score_bound(weights) >= threshold - ROUNDING_SLACK).drop(
        *[c for c in pairs.columns if c.startswith(("mask_", "signature_"))]
    )


def _n_met(wishes: str) -> Column:
    return F.size(F.array_intersect(wishes, "codes"))


def share(d: str) -> Column:
    """0-1 share of one dimension; null where the profile states no wish for it."""
    met = _n_met(f"code_{d}")
    part = F.when(met > 0, 1.0).otherwise(0.0) if d in _ANY_OF else met / F.size(f"code_{d}")
    return F.when(F.size(f"code_{d}") > 0, part)


def unwanted_hits() -> Column:
    return _n_met("code_unwanted")


def with_shares(pairs: DataFrame) -> DataFrame:
    """Candidates with their shares; of a pair met at several features only the first stays.

    The shares come out of generators of one row each. A filter on them cannot be pushed
    below, so the join condition stays as small as the score bound and each share is
    evaluated once, for pairs that passed the bound. Several small generators instead of
    one keep each generated method short enough for the JVM to compile.
    """
    first = F.element_at(F.array_intersect("probes", "codes"), 1)
    kept = computed(pairs, _first=first == F.col("code")).where("_first").drop("_first", "code", "probes")
    return shares(kept)


def shares(pairs: DataFrame) -> DataFrame:
    """Pairs that hold both sides' codes, with every dimension's share and the unwanted hits."""
    kept = pairs
    for group in (("role", "technology"), ("seniority", "modality"), ("location", "required")):
        kept = computed(kept, **{f"{d}_share": share(d) for d in group})
    kept = computed(kept, unwanted_hits=unwanted_hits())
    return kept.drop("codes", *[c for c in pairs.columns if c.startswith("code_")])


def _points(d: str, weights: Weights) -> Column:
    return F.lit(getattr(weights, d)) * F.coalesce(f"{d}_share", F.lit(0.0))


def total_score(weights: Weights = DEFAULTS.weights) -> Column:
    """Weighted mean of the stated dimensions on 0-100, plus bonus, minus penalty, half up."""
    earned = _points(DIMENSIONS[0], weights)
    for d in DIMENSIONS[1:]:
        earned = earned + _points(d, weights)
    base = F.when(F.col("total_weight") > 0, F.lit(100.0) * earned / F.col("total_weight")).otherwise(0.0)
    raw = (
        base
        + F.lit(weights.required_bonus) * F.coalesce("required_share", F.lit(0.0))
        - F.lit(weights.unwanted_penalty) * F.col("unwanted_hits")
    )
    return F.floor(F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0)) + 0.5).cast("int")


def classify(score: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(score >= settings.apply_cutoff, APPLY)
        .when(score >= settings.review_cutoff, REVIEW)
        .otherwise(IGNORE)
    )


def score_candidates(
    candidates: DataFrame, threshold: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Candidates at or above ``threshold`` with shares, score and class as columns.

    The feature arrays stay for the explanation, which is then built for kept pairs only.
    """
    scored = with_shares(candidates).withColumn("score", total_score(settings.weights))
    return scored.where(F.col("score") >= threshold).withColumn(
        "classification", classify(F.col("score"), settings)
    )


def score_pairs(
    pairs: DataFrame, postings: DataFrame, profiles: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Every pair of the list ``profile_id, job_id`` scored and classified, whatever its score.

    The list may be any: work grows with it, not with the product of both tables.
    """
    skip = lambda df: df.drop(*[c for c in df.columns if c.startswith(("mask_", "signature_"))])
    both = pairs.select("profile_id", "job_id").join(skip(profiles), "profile_id").join(skip(postings), "job_id")
    scored = shares(both).withColumn("score", total_score(settings.weights))
    return scored.withColumn("classification", classify(F.col("score"), settings))


def _matched(d: str) -> Column:
    return F.array_intersect(f"want_{d}", "features")


def _terms(d: str, features: Column) -> Column:
    return F.transform(features, lambda f: F.substr(f, F.lit(len(_FEATURE[d]) + 2)))


def _named(d: str, features: Column) -> Column:
    return F.transform(_terms(d, features), lambda t: F.concat(F.lit(f"{d}: "), t))


def strengths() -> Column:
    """Every wish the posting meets, as ``dimension: term``."""
    return F.array_sort(F.concat(*[_named(d, _matched(d)) for d in _FEATURE]))


def gaps() -> Column:
    """Wishes the posting misses; alternatives count as missed only when none is met."""
    missed = []
    for d in _FEATURE:
        lacking = F.array_except(f"want_{d}", "features")
        if d in _ANY_OF:
            lacking = F.when(F.col(f"{d}_share") == 0, lacking).otherwise(
                F.array().cast("array<string>")
            )
        missed.append(_named(d, lacking))
    return F.array_sort(F.concat(*missed))


# How each dimension is named in the reason sentence.
_SPOKEN = {
    "role": "cargo", "technology": "tecnologias", "seniority": "senioridade",
    "modality": "modalidade", "location": "localização", "required": "termos obrigatórios",
}


def reason() -> Column:
    """One sentence built from the same counts the score uses."""
    parts = []
    for d, spoken in _SPOKEN.items():
        stated = F.size(f"want_{d}") > 0
        if d in _ANY_OF:
            text = F.when(F.col(f"{d}_share") > 0, f"{spoken} compatível").otherwise(
                f"{spoken} não compatível"
            )
        else:
            text = F.format_string(f"{spoken} %d/%d", F.size(_matched(d)), F.size(f"want_{d}"))
        parts.append(F.when(stated, text))
    parts.append(
        F.when(F.col("unwanted_hits") > 0, F.format_string("termos indesejados %d", F.col("unwanted_hits")))
    )
    return F.concat(
        F.format_string("%s (%d): ", F.col("classification"), F.col("score")),
        F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("sem preferências")),
        F.lit("."),
    )


def breakdown_points(d: str, settings: Settings = DEFAULTS) -> Column:
    weights = settings.weights
    if d == "required":
        return F.lit(weights.required_bonus) * F.coalesce("required_share", F.lit(0.0))
    if d == "unwanted":
        return F.lit(-weights.unwanted_penalty) * F.col("unwanted_hits")
    return F.when(
        F.col("total_weight") > 0, F.lit(100.0) * _points(d, weights) / F.col("total_weight")
    ).otherwise(0.0)


def score_breakdown(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Long explanation: one row per pair and dimension that played a part."""
    rows = []
    for d in (*_FEATURE, "unwanted"):
        if d == "unwanted":
            hits = F.array_intersect("unwanted_penalize", "features")
            listed, found = F.size(hits) > 0, F.transform(hits, lambda f: F.substr(f, F.lit(6)))
        else:
            listed = F.size(f"want_{d}") > 0
            found = _terms(d, _matched(d))
        row = F.struct(
            F.lit(d).alias("dimension"),
            breakdown_points(d, settings).alias("points"),
            F.array_sort(found).alias("evidence"),
        )
        rows.append(F.when(listed, row))
    kept = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return scored.select("profile_id", "job_id", F.inline(kept))


def analyses(scored: DataFrame, scored_at: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Scored pairs as rows of the analyses table."""
    entries = [
        F.struct(F.lit(d), breakdown_points(d, settings)) for d in (*_FEATURE, "unwanted")
    ]
    return scored.select(
        "profile_id",
        "job_id",
        "score",
        F.map_from_entries(F.array(*entries)).alias("breakdown"),
        strengths().alias("strengths"),
        gaps().alias("gaps"),
        reason().alias("reason"),
        "classification",
        F.col("version").alias("profile_version"),
        scored_at.cast("timestamp").alias("scored_at"),
    )


def rank_jobs(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` postings per profile: score, then newest, then id."""
    order = Window.partitionBy("profile_id").orderBy(
        F.desc("score"), F.desc_nulls_last("posted_at"), "job_id"
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stale_pairs(pairs: DataFrame, analysed: DataFrame) -> DataFrame:
    """Pairs not yet analysed for the profile's present version: changed profiles, new postings."""
    done = analysed.select(
        "profile_id", F.col("profile_version").alias("version"), "job_id"
    )
    return pairs.join(done, ["profile_id", "version", "job_id"], "left_anti")
