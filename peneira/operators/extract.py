"""From raw messages to posting rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.config import DEFAULTS, JOB_FIELDS
from peneira.functions.dates import parse_date
from peneira.functions.html import html_to_text, mail_to_text
from peneira.functions.links import canonical_url, host
from peneira.functions.once import computed, let
from peneira.functions.text import collapse_space
from peneira.operators.keyed import broadcast_if_bounded

GENERIC = "generic"
MAX_BROADCAST_SOURCES = 100_000
BLOCK_SEPARATOR = r"\n-{5,}[ \t]*\n"

_LINE = r"[^\n]*"


def _between(lines: int, end: str) -> str:
    """Text after the first ``lines`` lines, up to a line starting with ``end``."""
    return rf"(?si)^(?:{_LINE}\n){{{lines}}}(?:{end}.*|(.*?)(?:\n{end}.*)?)$"


# Where each layout keeps a field; group 1 is the value. A new layout is one
# more entry, and a source names it in its parser column.
RULES: dict[str, dict[str, str]] = {
    "linkedin": {
        "title": rf"^({_LINE})",
        "company": rf"^{_LINE}\n({_LINE})",
        "location": rf"^{_LINE}\n{_LINE}\n({_LINE})",
        "url": r"(?m)^(?:Ver vaga|View job): *(\S+)",
        "date_text": rf"(?m)^(?:Publicada|Posted): *({_LINE})",
        "description": _between(3, r"(?:Publicada|Posted|Ver vaga|View job):"),
    },
    "indeed": {
        "title": rf"^({_LINE})",
        "company": rf"^{_LINE}\n([^\n]*?)(?: - {_LINE})?(?:\n|$)",
        "location": rf"^{_LINE}\n[^\n]*? - ({_LINE})",
        "url": r"(?mi)^(https?://\S+)$",
        "date_text": rf"(?m)^(?:Publicado(?: em)?|Posted):? *({_LINE})",
        "description": _between(2, r"(?:Publicado|Posted|https?://)"),
    },
    GENERIC: {
        "title": rf"(?mi)^(?:cargo|vaga|title|job): *({_LINE})",
        "company": rf"(?mi)^(?:empresa|company): *({_LINE})",
        "location": rf"(?mi)^(?:local|localização|location): *({_LINE})",
        "url": r"(?i)(https?://[^\s<>\"]+)",
        "date_text": rf"(?mi)^(?:data|date): *({_LINE})",
        "description": (
            r"(?si)(?:^|\n)(?:descrição|description): *(.*?)"
            r"(?:\n(?:cargo|vaga|title|job|empresa|company|local|localização|location|data|date|link|url):.*)?$"
        ),
    },
}


def route_parser(messages: DataFrame, sources: DataFrame, rules: Mapping = RULES) -> DataFrame:
    """Messages with the parser their source names; unknown sources use the generic one."""
    known = F.when(F.col("parser").isin(*rules), F.col("parser"))
    carried = [c for c in ("source_id",) if c in sources.columns and c not in messages.columns]
    registry = broadcast_if_bounded(sources.select("label", "parser", *carried), MAX_BROADCAST_SOURCES)
    return messages.join(registry, "label", "left").withColumn(
        "parser", F.coalesce(known, F.lit(GENERIC))
    )


def message_text(raw_text: Column, raw_html: Column) -> Column:
    """Text part of a mail, or its HTML as text where the text part is missing or blank."""
    return F.when(F.trim(F.coalesce(raw_text, F.lit(""))) != "", raw_text).otherwise(
        mail_to_text(raw_html)
    )


def split_blocks(messages: DataFrame, separator: str = BLOCK_SEPARATOR) -> DataFrame:
    """One row per non-blank block of the message text, numbered from 1."""
    text = F.regexp_replace(message_text(F.col("raw_text"), F.col("raw_html")), "\r\n?", "\n")
    pieces = F.filter(F.split(text, separator), lambda b: F.trim(b) != "")
    carried = [c for c in messages.columns if c not in ("raw_text", "raw_html")]
    return (
        messages.select(*carried, F.posexplode(pieces).alias("block_no", "block"))
        .withColumn("block_no", F.col("block_no") + 1)
        .withColumn("block", F.regexp_replace("block", r"^[ \t\n]+|[ \t\n]+$", ""))
    )


def split_html_blocks(pages: DataFrame, html: str = "raw_html", tag: str = "p") -> DataFrame:
    """One row per ``<tag>`` element's inner HTML; an element left open ends at the next."""
    openings = F.split(F.col(html), rf"(?i)<{tag}(?:\s[^>]*)?>")
    bodies = F.transform(
        F.slice(openings, 2, F.size(openings)),
        lambda b: F.regexp_replace(b, rf"(?is)</{tag}>.*$", ""),
    )
    carried = [c for c in pages.columns if c != html]
    return pages.select(*carried, F.posexplode(bodies).alias("block_no", "block")).withColumn(
        "block_no", F.col("block_no") + 1
    )


def extract_fields(blocks: DataFrame, rules: Mapping[str, Mapping[str, str]] = RULES) -> DataFrame:
    """Blocks with the fields their parser's layout states; absent fields are null."""

    def pick(field: str) -> Column:
        chosen = F.lit(None).cast("string")
        for parser, layout in rules.items():
            value = F.regexp_extract("block", layout[field], 1)
            chosen = F.when(F.col("parser") == parser, value).otherwise(chosen)
        return F.nullif(F.trim(chosen), F.lit(""))

    fields = ("title", "company", "location", "url", "date_text", "description")
    return computed(blocks, **{f: pick(f) for f in fields})


def extract_layout(blocks: DataFrame, parser: str) -> DataFrame:
    """Fields of the blocks of one layout only."""
    return extract_fields(blocks.where(F.col("parser") == parser), {parser: RULES[parser]})


def extract_page(pages: DataFrame, html: str = "raw_html") -> DataFrame:
    """Generic fields of one posting page: heading, site, first absolute link, first paragraph."""

    def inner(pattern: str) -> Column:
        return F.nullif(
            collapse_space(html_to_text(F.regexp_extract(html, pattern, 1))), F.lit("")
        )

    return pages.select(
        "message_id",
        inner(r"(?is)<h1[^>]*>(.*?)</h1>").alias("title"),
        host(F.col("url")).alias("company"),
        F.nullif(F.regexp_extract(html, r'(?i)href="([^"]+)"', 1), F.lit("")).alias("first_link"),
        inner(r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p[ >])").alias("description"),
    )


def missing_fields(columns: tuple[str, ...] = JOB_FIELDS) -> Column:
    """Names of the stated fields a posting lacks."""
    return F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull()
    )


def extract_jobs(
    messages: DataFrame, sources: DataFrame, parser_version: int = DEFAULTS.parser_version
) -> DataFrame:
    """Posting rows of all messages, one message giving any number of them.

    A block naming neither a title nor a link is not a posting; incomplete ones are kept.
    """
    blocks = split_blocks(route_parser(messages, sources))
    found = extract_fields(blocks).where("title is not null or url is not null")
    if "source_id" not in found.columns:
        found = found.withColumn("source_id", F.lit(None).cast("long"))
    none = F.lit(None).cast("string")
    return (
        found.withColumns(
            {
                "lang": language(F.concat_ws(" ", "title", "description")),
                "technologies": F.lit(None).cast("array<string>"),
                "seniority": none,
                "modality": none,
                "extracted_at": F.col("received_at").cast("timestamp"),
            }
        ).withColumn("job_id", F.concat_ws("-", "message_id", "block_no"))
        .withColumn("posted_at", parse_date(F.col("date_text"), F.col("received_at")))
        .withColumn("canonical_url", canonical_url(F.col("url")))
        .withColumn("missing_fields", missing_fields())
        .withColumn("parser_version", F.lit(parser_version))
        .select(
            "job_id", "message_id", "block_no", "label", "parser", "title", "company", "location",
            "url", "canonical_url", "description", "posted_at", "missing_fields", "parser_version",
            "received_at", "source_id", "lang", "technologies", "seniority", "modality", "extracted_at",
        )
    )


# Frequent short words of each language a posting may be in.
LANGUAGE_WORDS = {
    "pt": ("de", "e", "para", "com", "em", "uma", "um", "os", "as", "do", "da", "na", "no", "que", "buscamos", "vaga"),
    "en": ("the", "of", "and", "to", "in", "for", "with", "on", "is", "we", "you", "a", "at", "our", "this"),
    "es": ("el", "los", "las", "y", "para", "con", "en", "una", "un", "del", "que", "la", "de", "se", "por"),
    "fr": ("le", "les", "et", "des", "pour", "dans", "une", "un", "est", "la", "de", "du", "que", "en", "par"),
    "de": ("der", "die", "und", "das", "mit", "ist", "ein", "eine", "von", "im", "zu", "den", "nicht", "auf", "für"),
}


def _occurring(words: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def language(text: Column) -> Column:
    """Language whose frequent words make up most of the text; null if none of them occurs."""

    def pick(words: Column) -> Column:
        counts = [
            F.struct(_occurring(words, known).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang"))
            for k, (lang, known) in enumerate(LANGUAGE_WORDS.items())
        ]
        return let(F.array_max(F.array(*counts)), lambda best: F.when(best["n"] > 0, best["lang"]))

    return let(F.split(F.lower(text), r"[^\p{L}]+"), pick)


def extraction_failures(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages that gave no posting, with a reason; the raw content stays in the store."""
    empty = (F.trim(F.coalesce("raw_text", F.lit(""))) == "") & (
        F.trim(F.coalesce("raw_html", F.lit(""))) == ""
    )
    error = F.when(empty, "empty_message").otherwise("no_posting_found").alias("error")
    # The reason is found first: bodies stay out of the join.
    return messages.select("message_id", "label", error).join(jobs.select("message_id"), "message_id", "left_anti")


def to_reprocess(
    messages: DataFrame,
    jobs: DataFrame,
    failures: DataFrame,
    version: int = DEFAULTS.parser_version,
) -> DataFrame:
    """Stored messages worth parsing again: failed, incomplete or parsed by an older version."""
    outdated = jobs.where((F.size("missing_fields") > 0) | (F.col("parser_version") < version))
    due = failures.select("message_id").union(outdated.select("message_id")).distinct()
    return messages.join(due, "message_id", "left_semi")
