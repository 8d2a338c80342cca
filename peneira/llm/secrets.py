"""Secret scans over a ledger of blobs; built-in expressions only."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.functions.once import let
from peneira.llm.common import spread_join, whole_text
from peneira.session import scratch_path, stage


@dataclass(frozen=True)
class Rule:
    """A pattern and the least length of one of its groups; a match that is too short is dropped, not retried."""

    kind: str
    pattern: str
    group: int
    least: int


# The kinds in their order and their patterns.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# What a text must hold for a rule to find anything: a cheaper pattern tried first.
_WORTH = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
# Runs of hex digits of the least length are the same matches: a shorter run can't be part of one.
_SEARCHED = {"hex": r"[0-9a-f]{16,}"}


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Content address of a rule set: any change of a rule makes every blob unseen."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, stop>>`` of a rule's matches, in code points, end exclusive.

    Matches and the pieces between them come from the same pattern, so their lengths add up
    to every match's place. The work is linear in the text and its matches.
    """
    pattern = _SEARCHED.get(rule.kind, rule.pattern)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pieces = F.arrays_zip(matches.alias("match"), F.slice(between, F.lit(1), F.size(matches)).alias("before"))
    measured = F.transform(pieces, lambda p: _measured(p, rule))
    spans = let(measured, _placed)
    return F.when(F.rlike(text, F.lit(_WORTH[rule.kind])), spans).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:long,stop:long>>"
# Sums are taken in blocks of this many values and, this many levels deep, over blocks of blocks.
_BLOCK, _LEVELS = 64, 3


def _measured(piece: Column, rule: Rule) -> Column:
    """Lengths of what stands before a match and of the match, and whether it is long enough to count."""
    match = piece["match"]
    value = match if rule.group == 0 else F.regexp_extract(match, rule.pattern, rule.group)
    return F.struct(
        F.length(piece["before"]).cast("long").alias("before"), F.length(match).cast("long").alias("own"), (F.length(value) >= rule.least).alias("counts")
    )


def _placed(measured: Column) -> Column:
    bases = sums_before(F.transform(measured, lambda m: m["before"] + m["own"]))
    all_spans = F.zip_with(
        measured,
        bases,
        lambda m, at: F.struct((at + m["before"]).alias("start"), (at + m["before"] + m["own"]).alias("stop"), m["counts"].alias("counts")),
    )
    return F.transform(F.filter(all_spans, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))


def _scan(values: Column, base: Column) -> Column:
    """``base`` plus the sum before each of a few values; every step copies what it has so far."""
    grown = F.aggregate(
        values,
        F.struct(base.alias("at"), F.array().cast("array<long>").alias("out")),
        lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )
    return grown["out"]


def sums_before(values: Column, levels: int = _LEVELS) -> Column:
    """The sum of all values before each value of an ``array<long>``.

    An array can't be extended in place, so a plain running sum copies the square of its length.
    Here arrays of at most a block are extended, and blocks' totals are summed the same way: the
    work is in proportion to the length, beyond ``_BLOCK ** (_LEVELS + 1)`` values, about
    16 million, somewhat more.
    """
    if not levels:
        return _scan(values, F.lit(0).cast("long"))

    def in_blocks(all_values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(all_values) / _BLOCK).cast("int"))
        return F.filter(
            F.transform(numbers, lambda k: F.slice(all_values, k * _BLOCK + 1, F.lit(_BLOCK))), lambda block: F.size(block) > 0
        )

    def scanned(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, v: acc + v))
        return F.flatten(F.zip_with(blocks, sums_before(totals, levels - 1), _scan))

    return let(values, lambda v: let(in_blocks(v), scanned))


def _tagged(k: int, rule: Rule) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind_no"), F.lit(rule.kind).alias("kind"), s["stop"].alias("stop"))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``array<struct<start, kind_no, kind, stop>>`` of all rules, ordered by start, then kind."""
    each = [F.transform(_spans(text, rule), _tagged(k, rule)) for k, rule in enumerate(rules)]
    return F.array_sort(F.concat(*each))


class BlobLedger:
    """What was scanned: one row per (blob, rule version) with its findings, under ``folder``.

    Rows are appended by whole jobs, so a run that is broken off leaves none behind and the
    next takes its blobs again; a blob scanned twice by chance counts once.
    """

    SCHEMA = "blob string, version string, spans array<struct<start: long, kind_no: int, kind: string, stop: long>>"

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules
        self.version = rule_version(rules)

    def entries(self) -> DataFrame:
        """Rows of this rule version."""
        try:
            stored = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/entries")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = self.spark.createDataFrame([], self.SCHEMA)
        return stored.where(F.col("version") == self.version)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """``_path, blob``: one place of each blob of ``versions(_path, blob)`` not scanned under these rules."""
        places = versions.groupBy("blob").agg(F.min("_path").alias("_path"))
        return places.join(self.entries().select("blob"), "blob", "left_anti")

    def scan(self, versions: DataFrame, texts: DataFrame) -> None:
        """Scan the unseen blobs of ``versions(_path, blob)``; ``texts(_path, blob, text)`` holds their contents."""
        todo = stage(self.unseen(versions), "unseen")
        found = texts.join(todo, ["_path", "blob"], "left_semi").select(
            "blob", F.lit(self.version).alias("version"), find_spans(F.col("text"), self.rules).alias("spans")
        )
        found.write.mode("append").parquet(f"{self.folder}/entries")

    def findings(self) -> DataFrame:
        """``blob, spans`` of blobs with findings under these rules."""
        return self.entries().where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))


def scan_versions(versions: DataFrame, path_cols: list[str], text_col: str, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path_cols``, ``blob`` and ``spans`` of every stored version, unchanged ones without a new scan.

    A blob is the SHA-256 of a whole text (null counts as empty); copies and versions with
    equal texts are one blob and scanned once. Findings go back to every path of a blob;
    paths of blobs without any have an empty list. Repeated rows keep a row each; null path
    columns are values like others; an empty table gives no rows and scans nothing.
    """
    spark = versions.sparkSession
    ledger = BlobLedger(spark, folder, rules)
    path = F.xxhash64(*path_cols)
    texts = versions.select(path.alias("_path"), F.sha2(whole_text(text_col), 256).alias("blob"), whole_text(text_col).alias("text"))
    rows = stage(versions.select(F.struct(*path_cols).alias("_row"), path.alias("_path"), F.sha2(whole_text(text_col), 256).alias("blob")), "versions")
    ledger.scan(rows.select("_path", "blob"), texts)
    counts = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("_paths"))
    findings = ledger.findings().join(counts, "blob")
    found = spread_join(rows, findings, ["blob"], F.col("_path"), "_paths", "left")
    return found.select("_row.*", "blob", F.coalesce("spans", F.array().cast("array<struct<start:long,kind_no:int,kind:string,stop:long>>")).alias("spans"))


def document_secrets(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``docs``."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan_versions(narrow, ["doc_id"], "text", folder or scratch_path(spark, "blobs"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


# DuckDB form of document_secrets, rule by rule; the same lengths add up to the same places.
def _sql_spans(k: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("(?i:", "(?:").replace("'", "''")
    for word in ("password", "passwd", "secret", "token", "api_?key"):
        pattern = pattern.replace(word, "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word), 1) if rule.kind == "assign" else pattern
    return f"""SELECT doc_id, {k} AS kind_no, '{rule.kind}' AS kind,
      list_transform(range(1, len(m) + 1), lambda i: struct_pack(
        a := CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT),
        n := length(m[i]),
        v := length(regexp_extract(m[i], '{pattern}', {rule.group})))) AS hits
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS b FROM t)"""


ORACLE = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), raw AS ("
    + " UNION ALL ".join(_sql_spans(k, rule) for k, rule in enumerate(RULES))
    + "), spans AS (SELECT doc_id, kind_no, kind, h.a AS a, h.a + h.n AS z FROM (SELECT doc_id, kind_no, kind, unnest(hits) AS h FROM raw) WHERE "
    + " OR ".join(f"(kind_no = {k} AND h.v >= {rule.least})" for k, rule in enumerate(RULES))
    + """), joined AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, kind_no) AS spans,
      count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex
      FROM spans GROUP BY doc_id)
    SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
      CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN joined USING (doc_id)"""
)
