"""From postings and profiles to scored, flagged and ranked pairs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.config import DEFAULTS, Settings
from peneira.operators import classes as K
from peneira.operators import clean as C
from peneira.operators import profiles as P
from peneira.operators import score as S
from peneira.operators import tagging as T
from peneira.operators.keyed import lookup
from peneira.operators.similarity import near_dup_pairs
from peneira.operators.term_index import TermIndex
from peneira.session import stage


# Share of profiles still open after a round from which further rounds before the last don't pay.
LEAST_LEFT = 0.7


@dataclass(frozen=True)
class Inputs:
    """Feature tables every scoring run starts from, written once."""

    postings: DataFrame
    profiles: DataFrame
    counts: DataFrame


def near_links(texts: DataFrame, id_col: str = "job_id", text_col: str = "description", settings: Settings = DEFAULTS) -> DataFrame:
    """Stored links ``id_a, id_b`` between postings with near-equal texts, for ``prepare``."""
    pairs = near_dup_pairs(texts, id_col, text_col, settings.near_dup_jaccard, settings.shingle_words)
    return stage(pairs.select("id_a", "id_b"), "near-links")


def prepare(
    jobs: DataFrame,
    profiles: DataFrame,
    places: DataFrame,
    settings: Settings = DEFAULTS,
    links: DataFrame | None = None,
    index: TermIndex | None = None,
) -> Inputs:
    """Tag and clean the postings and normalise the preferences.

    Postings that share a link or company, title and location are one group of duplicates;
    ``links`` joins further ones, as of near-equal texts (``near_links``). With an ``index`` that
    holds the postings nothing is read from their texts again: only terms the index
    does not know yet are looked for, in its words.
    """
    terms = P.profile_terms(profiles, settings.weights)
    dictionary = stage(T.term_dictionary(terms), "dictionary")
    flags = C.job_flags(jobs, links)
    if index is None:
        features = T.job_features(jobs, dictionary, places, flags)
    else:
        index.add_terms(dictionary, uuid.uuid4().hex)
        held = jobs.select("job_id")
        facts = index.facts().join(held, "job_id", "left_semi")
        features = T.features_of(facts, index.tags(dictionary), places, flags)
    postings = stage(S.posting_features(features), "postings")
    wide = S.scoring_profiles(P.profile_features(profiles), settings.weights)
    return Inputs(postings, stage(wide, "profiles"), S.feature_counts(postings))


def review_threshold(settings: Settings = DEFAULTS) -> Column:
    """The lowest score worth a look: from here on every pair is found, for all profiles alike."""
    return F.lit(float(settings.review_cutoff))


def candidates(inputs: Inputs, threshold: Column, settings: Settings = DEFAULTS, admitted: Column | None = None) -> DataFrame:
    """Pairs that may reach ``threshold``, of those that are ``admitted``."""
    probes = stage(
        S.probe_features(inputs.profiles, inputs.counts, threshold, settings.weights), "probes"
    )
    return S.candidate_pairs(
        inputs.postings, inputs.profiles, probes, inputs.counts, threshold, settings.weights, admitted
    )


def score(inputs: Inputs, threshold: Column, settings: Settings = DEFAULTS, admitted: Column | None = None) -> DataFrame:
    """Every pair at or above ``threshold``, of those that are ``admitted``, scored and classified."""
    return S.score_candidates(candidates(inputs, threshold, settings, admitted), threshold, settings)


def rescore(
    inputs: Inputs, changed: DataFrame, new: DataFrame, threshold: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Pairs that a change touches: changed profiles with all postings, the others with new postings.

    ``changed`` holds ``profile_id``, ``new`` holds ``job_id``. Both sides are cut before they
    meet, so neither old pairs nor the stored triage are read.
    """
    touched = stage(inputs.profiles.join(changed.select("profile_id"), "profile_id", "left_semi"), "changed-profiles")
    others = stage(inputs.profiles.join(changed.select("profile_id"), "profile_id", "left_anti"), "other-profiles")
    fresh = stage(inputs.postings.join(new.select("job_id"), "job_id", "left_semi"), "new-postings")
    whole = Inputs(inputs.postings, touched, inputs.counts)
    added = Inputs(fresh, others, S.feature_counts(fresh))
    return score(whole, threshold, settings).unionByName(score(added, threshold, settings))


def top_jobs(triaged_pairs: DataFrame, k: int) -> DataFrame:
    """Best ``k`` active postings per profile."""
    active = triaged_pairs.where("status = 'active'").select(
        "profile_id", "job_id", "posted_at", "score", "classification"
    )
    ranked = S.rank_jobs(active, k)
    return ranked.select("profile_id", "rank", "job_id", "posted_at", "score", "classification")


@dataclass(frozen=True)
class Classes:
    """Postings and profiles with their classes, and one row per class; all of them stored."""

    postings: DataFrame
    profiles: DataFrame
    posting_heads: DataFrame
    profile_heads: DataFrame

    def inputs(self) -> Inputs:
        """Heads in place of postings and profiles: scoring them scores every pair they stand for."""
        heads = self.posting_heads.drop("class", "members", "hidden", "n_postings")
        return Inputs(heads, self.profile_heads.drop("class", "n_profiles"), S.feature_counts(heads))


def classes(inputs: Inputs, as_of: Column, k: int, settings: Settings = DEFAULTS) -> Classes:
    """Classes of everything, with the ``k`` best postings of each class of postings."""
    limits = K.age_limits(inputs.profiles, settings)
    postings = stage(K.classed_postings(inputs.postings, as_of, limits), "classed-postings")
    profiles = stage(K.classed_profiles(inputs.profiles, settings), "classed-profiles")
    return Classes(
        postings, profiles, stage(K.posting_heads(postings, k), "posting-heads"), stage(K.profile_heads(profiles), "profile-heads")
    )


def best_jobs(found: Classes, as_of: Column, k: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Best ``k`` active postings per profile from the review cut-off on, without forming all such pairs.

    Rounds go down from high scores to the cut-off. A round finds all pairs of classes at or above its score for
    the profiles still open; whoever has k active postings by then is settled, since whatever
    is left scores less. A round that settles few is the last but one: the next takes the cut-off.
    Postings too old for a profile are passed over before anything else of the pair is looked
    at. What is kept is at most k postings per profile; a class of postings counts as one.
    """
    postings = found.posting_heads.where("not hidden").drop("class", "members", "hidden", "n_postings")
    counts = stage(S.feature_counts(postings), "feature-counts")
    open_, ranked = found.profile_heads.drop("class", "n_profiles"), None
    steps = [*(s for s in settings.rank_steps if s > settings.review_cutoff), settings.review_cutoff]
    while steps:
        step = steps.pop(0)
        pairs = _resolved(score(Inputs(postings, open_, counts), F.lit(float(step)), settings, ~C.stale(as_of)), as_of)
        top = stage(K.ranked_members(pairs.where("status = 'active'"), found.posting_heads, k), f"ranked-{step}")
        settled = top.where(F.col("rank") == k).select("profile_id")
        part = top.join(settled, "profile_id", "left_semi") if steps else top
        ranked = part if ranked is None else ranked.unionByName(part)
        if steps:
            before, open_ = open_.count(), stage(open_.join(settled, "profile_id", "left_anti"), "open-profiles")
            left = open_.count()
            if not left:
                break
            if left > LEAST_LEFT * before:
                steps = steps[-1:]
    heads = found.profile_heads.select("class", F.col("profile_id").alias("_head"))
    members = found.profiles.select("profile_id", "class").join(heads, "class").drop("class")
    return members.join(ranked.withColumnRenamed("profile_id", "_head"), "_head").drop("_head")


def class_pairs(found: Classes, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Pairs of classes from the review cut-off on: ``posting_class, n_profiles, n_postings, score, classification, status``."""
    names = found.posting_heads.select("job_id", F.col("class").alias("posting_class"), "n_postings")
    counts = found.profile_heads.select("profile_id", "n_profiles")
    pairs = _resolved(score(found.inputs(), review_threshold(settings), settings), as_of)
    kept = pairs.select("profile_id", "job_id", "score", "classification", "status")
    return lookup(lookup(kept, counts, ["profile_id"]), names, ["job_id"]).drop("profile_id", "job_id")


def posting_counts(found: Classes, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """What becomes of each posting's pairs with all profiles: see ``classes.class_counts``."""
    active = K.active_profiles(found.postings, found.profiles, as_of, settings)
    return K.class_counts(class_pairs(found, as_of, settings), found.postings, active, found.profiles.count())


_EXPLANATION = ("features", "want_", "unwanted_penalize", "discard", "avoid_")


def _resolved(scored: DataFrame, as_of: Column, apart: bool = False) -> DataFrame:
    flagged = C.resolve_status(C.flag_pairs(scored, as_of, apart))
    return flagged.drop(*[c for c in flagged.columns if c.startswith(_EXPLANATION)])


def triaged(inputs: Inputs, as_of: Column, settings: Settings = DEFAULTS, apart: bool = False) -> DataFrame:
    """Pairs of the classes `Aplicar` and `Avaliar`, all of them, with one visible status each.

    The rest, `Ignorar`, is most of the product of both tables: it is counted by subtraction
    and scored on request by ``triaged_pairs``. The term arrays are spent here: a stored
    pair is narrow, and ``explainable`` brings the arrays back for the pairs that are shown.
    Set ``apart`` to filter on the reasons of pairs that are not stored (``clean.flag_pairs``).
    """
    return _resolved(score(inputs, review_threshold(settings), settings), as_of, apart)


def shown(postings: DataFrame) -> DataFrame:
    """Postings that are active for whoever they are neither too old nor unfit for."""
    return postings.where(~F.coalesce("failed", F.lit(False)) & F.col("dup_of").isNull())


def active(inputs: Inputs, as_of: Column, settings: Settings = DEFAULTS, least: int | None = None) -> DataFrame:
    """The active pairs of ``triaged``, those that score ``least`` or more, without forming the others.

    Failed postings and duplicates are left out before postings and profiles meet, age is asked
    first where they meet, and profiles are looked up for the higher score only.
    """
    postings = stage(shown(inputs.postings), "shown-postings")
    kept = Inputs(postings, inputs.profiles, S.feature_counts(postings))
    cutoff = max(settings.review_cutoff, least or 0)
    found = score(kept, F.lit(float(cutoff)), settings, ~C.stale(as_of))
    return _resolved(found, as_of, apart=True).where("status = 'active'")


def triaged_pairs(inputs: Inputs, pairs: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Any list of pairs ``profile_id, job_id`` with score, class and status."""
    return _resolved(S.score_pairs(pairs, inputs.postings, inputs.profiles, settings), as_of)


def explainable(inputs: Inputs, pairs: DataFrame) -> DataFrame:
    """Stored pairs with the term arrays the explanation and the drafts are built from."""
    wishes = inputs.profiles.select(
        "profile_id", "unwanted_penalize",
        *[c for c in inputs.profiles.columns if c.startswith("want_")],
    )
    found = inputs.postings.select("job_id", "features")
    with_wishes = lookup(pairs, wishes, ["profile_id"])
    return lookup(with_wishes, found, ["job_id"])
