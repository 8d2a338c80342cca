"""Where every word of every posting stands, so that new terms are found without the texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.functions.once import computed
from peneira.functions.text import term_text, tokens
from peneira.operators import tagging as T
from peneira.operators.keyed import broadcast_if_bounded
from peneira.session import stage

_WORDS = "token string, job_id string, field string, positions array<int>, batch string"
_TERMS = "term_norm string, batch string"
_HITS = "job_id string, field string, term_norm string, batch string"
_FACTS = (
    "job_id string, posted_at date, title string, company string, location string, modality string, seniority string, contract string, batch string"
)
_FIELDS = {"title": "title", "body": "description"}


class TermIndex:
    """Postings' words, facts and found terms under ``path``, extended by batches of postings and of terms.

    New postings are searched for all known terms, new terms in the stored words of all
    postings; what was found before is not looked for again. A posting's text is read once,
    when it is added. A batch that is added again under its name replaces what it left, and a
    term found twice counts once, so a run that was broken off is simply repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def words(self) -> DataFrame:
        return self._read("words", _WORDS)

    def facts(self) -> DataFrame:
        """``tagging.posting_facts`` of all postings, as they were when they were added."""
        return self._read("facts", _FACTS).drop("batch")

    def add_postings(self, jobs: DataFrame, batch: str) -> None:
        """Take in postings with ids not seen before."""
        known = self._read("terms", _TERMS).select("term_norm").distinct()
        split = computed(jobs.select("job_id", *_FIELDS.values()), **{f"_{name}": tokens(term_text(F.col(c))) for name, c in _FIELDS.items()})

        def placed(name: str) -> Column:
            return F.transform(f"_{name}", lambda w, i: F.struct(F.lit(name).alias("field"), w.alias("token"), i.alias("position")))

        placements = split.select("job_id", F.inline(F.concat(*map(placed, _FIELDS))))
        words = placements.groupBy("token", "job_id", "field").agg(F.sort_array(F.collect_list("position")).alias("positions"))
        # Sorted, so that a search for some words opens few row groups.
        self._write(words.sortWithinPartitions("token"), "words", batch)
        self._write(T.posting_facts(jobs), "facts", batch)
        self._write(T.term_hits(jobs, known).select("job_id", "field", "term_norm"), "hits", f"postings-{batch}")

    def add_terms(self, dictionary: DataFrame, batch: str) -> None:
        """Look for the terms of ``dictionary`` (``term_norm``) that are new; known ones cost an anti-join."""
        known = self._read("terms", _TERMS).where(F.col("batch") != batch).select("term_norm")
        wanted = dictionary.select("term_norm").where("term_norm != ''").distinct()
        new = stage(wanted.join(known, "term_norm", "left_anti"), "new-terms")
        self._write(self.search(new), "hits", f"terms-{batch}")
        self._write(new, "terms", batch)

    def search(self, terms: DataFrame) -> DataFrame:
        """``job_id, field, term_norm``: where the words of each term stand in a row.

        Each word's places are moved back by its place in the term; a term stands where all
        its words agree on the start.
        """
        split = F.split("term_norm", " ")
        parts = terms.select("term_norm", F.size(split).alias("n"), F.posexplode(split).alias("offset", "token"))
        parts = stage(parts, "term-words")
        words = self.words()
        few = [r["token"] for r in parts.select("token").distinct().limit(T.MAX_HEADS + 1).collect()]
        if len(few) <= T.MAX_HEADS:
            words = words.where(F.col("token").isin(few))  # reaches the scan
        met = words.join(broadcast_if_bounded(parts, T.MAX_BROADCAST_TERMS), "token")
        starts = F.transform("positions", lambda p: p - F.col("offset"))
        single = met.where("n = 1").select("job_id", "field", "term_norm")
        several = met.where("n > 1").groupBy("job_id", "field", "term_norm", "n").agg(F.collect_list(starts).alias("starts"))
        agreed = F.aggregate("starts", F.element_at("starts", 1), F.array_intersect)
        whole = several.where(F.size("starts") == F.col("n")).where(F.size(agreed) > 0)
        return single.unionByName(whole.select("job_id", "field", "term_norm"))

    def tags(self, dictionary: DataFrame) -> DataFrame:
        """What ``tagging.tag_terms`` finds in the stored postings, for a dictionary whose terms have been added."""
        hits = self._read("hits", _HITS).drop("batch")
        return T.found_terms(hits.join(broadcast_if_bounded(dictionary, T.MAX_BROADCAST_TERMS), "term_norm"))
