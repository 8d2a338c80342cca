"""Every value the specification leaves open, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    """Points per scored dimension; dimensions a profile leaves empty drop out."""

    role: float = 25.0
    technology: float = 35.0
    seniority: float = 15.0
    modality: float = 10.0
    location: float = 15.0
    required_bonus: float = 20.0
    unwanted_penalty: float = 25.0


@dataclass(frozen=True)
class Settings:
    weights: Weights = field(default_factory=Weights)
    apply_cutoff: int = 80
    review_cutoff: int = 50
    draft_cutoff: int = 80
    rank_steps: tuple[int, ...] = (90, 80, 65)
    max_age_days: int = 30
    parser_version: int = 1
    default_lang: str = "pt"
    required_fields: tuple[str, ...] = ("title", "url")
    shingle_words: int = 5
    near_dup_jaccard: float = 0.8


DEFAULTS = Settings()

# Result classes and vocabulary labels.
APPLY, REVIEW, IGNORE = "Aplicar", "Avaliar", "Ignorar"
REMOTE, HYBRID, ON_SITE = "Remoto", "Híbrido", "Presencial"
SENIORITY_LEVELS = ("Júnior", "Pleno", "Sênior", "Lead")
CV_SECTIONS = (
    "summary", "experience", "project", "education", "certification", "language", "skill",
)
MATERIAL_KINDS = ("cv", "letter", "summary", "highlights")
JOB_FIELDS = ("title", "company", "location", "url", "posted_at", "description")

# Link parameters that identify a campaign and never a posting.
TRACKING_PARAM = r"^(utm_[a-z]+|ref|refid|trk|trackingid|fbclid|gclid|from|mc_[a-z]+)$"
