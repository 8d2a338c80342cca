"""Exact deduplication as a stream with disk-backed keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peneira.llm.common import ROWS_PER_SALT, spread_join, whole_text
from peneira.operators.keyed import keep_first
from peneira.session import scratch_path, stage

# State lives on the executors' disks and, per batch, in the checkpoint folder; native memory is bounded.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}
BLANKS = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09 to 0x0D."""
    return F.translate(text, BLANKS, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def place(batch: Column) -> Column:
    """Orders rows so that the largest stays: most code points, then smallest identifier (null last)."""
    small_first = F.bitwise_not(F.coalesce("doc_id", F.lit(0)))
    return F.struct("_points", F.col("doc_id").isNotNull().alias("known"), small_first.alias("rank"), batch.alias("batch"), "doc_id")


class Ledger:
    """Keyed state of all texts seen, under ``folder``: an intake, a checkpoint and a log of changes.

    Per text the state keeps for ever: the row that stays (code points, identifier, batch), the number
    of rows, and the locator of the text, the batch under whose name it was stored. There
    is no watermark: a copy is found however late it comes. A digest that is in the state already is a hit only after
    the text behind the locator was read and compared in full; texts that merely share a
    digest get keys of their own. Rows of a batch are written to the intake first; the stream takes each intake file exactly
    once, so a run that is broken off is continued, not repeated. Without ``keep_texts`` no
    text is stored and only one batch can be taken.
    """

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[Column], Column] = digest, keep_texts: bool = True):
        self.spark, self.folder, self.digest, self.keep_texts = spark, folder.rstrip("/"), digest, keep_texts

    def _intake(self) -> str:
        return f"{self.folder}/intake"

    def _begun(self) -> bool:
        try:
            self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def marked(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``_digest`` and ``_points``."""
        return docs.withColumns({"_digest": self.digest(whole_text()), "_points": F.length(whole_text()).cast("long")})

    def add(self, docs: DataFrame, batch: str = "0") -> None:
        """Take one batch of rows (``doc_id``, ``text``) into the state; ``batch`` is a name not used before."""
        begun = self._begun()
        if begun and not self.keep_texts:
            raise ValueError("a ledger without texts takes one batch only")
        plain = self.marked(docs).select(
            F.col("doc_id").cast("long").alias("doc_id"), "_digest", "_points", normalised(whole_text()).alias("_plain")
        )
        marks = stage(plain.drop("_plain"), "marks")
        apart = stage(_several_texts(plain, marks), "several-texts")
        stored = self._stored(marks) if begun else None
        asked = apart if stored is None else apart.union(stored.select("_digest")).distinct()
        simple = stored is None and apart.isEmpty()
        if simple:
            keyed = marks.select("*", F.col("_digest").alias("_key"), F.lit(batch).alias("located"))
        else:
            classes = stage(self._classes(plain.join(asked, "_digest", "left_semi"), stored, batch), "classes")
            # Of a digest with one text, which is most of them, rows need not bring theirs.
            single = classes.groupBy("_digest").agg(F.min("_key").alias("_key"), F.min("located").alias("located"), F.count(F.lit(1)).alias("n"))
            single = stage(single, "single")
            several = single.where("n > 1").select("_digest")
            by_text = plain.join(several, "_digest", "left_semi").join(classes.drop("is_new"), ["_digest", "_plain"]).drop("_plain")
            by_digest = marks.join(several, "_digest", "left_anti").join(single.drop("n"), "_digest", "left")
            by_digest = by_digest.withColumns({"_key": F.coalesce("_key", "_digest"), "located": F.coalesce("located", F.lit(batch))})
            keyed = by_digest.unionByName(by_text)
        if self.keep_texts:
            fresh = plain if simple else plain.join(asked, "_digest", "left_anti")
            texts = fresh.groupBy(F.col("_digest").alias("_key")).agg(F.min("_plain").alias("_plain"))
            if not simple:
                texts = texts.unionByName(classes.where("is_new").select("_key", "_plain"))
            texts.write.mode("overwrite").parquet(f"{self.folder}/texts/batch={batch}")
        rows = keyed.select("_key", "_digest", "_points", "doc_id", F.lit(batch).alias("batch"), "located")
        rows.write.mode("append").parquet(self._intake())
        self._consume()

    def _stored(self, marks: DataFrame) -> DataFrame:
        """``_key, _digest, located, _plain`` of the texts in the state whose digest is among ``marks``: locators are followed."""
        here = marks.select("_digest").distinct()
        hits = stage(self.entries().join(here, "_digest", "left_semi").select("_key", "_digest", "located"), "hits")
        texts = self.spark.read.schema("_key string, _plain string, batch string").parquet(f"{self.folder}/texts")
        found = hits.join(texts.withColumnRenamed("batch", "located"), ["located", "_key"])
        return stage(found.select("_key", "_digest", "located", "_plain"), "hit-texts")

    def _classes(self, plain: DataFrame, stored: DataFrame | None, batch: str) -> DataFrame:
        """``_digest, _plain, _key, located, is_new``: every different text of ``plain`` with the key of the stored text it equals, or one of its own."""
        own = plain.groupBy("_digest", "_plain").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
        if stored is None:
            known = own.withColumns({"_key": F.lit(None).cast("string"), "located": F.lit(None).cast("string"), "taken": F.lit(False)})
        else:
            taken = stored.select("_digest", F.lit(True).alias("taken")).distinct()
            known = own.join(stored, ["_digest", "_plain"], "left").join(taken, "_digest", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
        number = F.row_number().over(Window.partitionBy("_digest").orderBy("_plain"))
        fresh = F.when(~F.col("taken") & (number == 1), F.col("_digest")).otherwise(F.concat_ws("#", "_digest", F.lit(batch), number))
        return known.select(
            "_digest", "_plain", F.coalesce("_key", fresh).alias("_key"), F.coalesce("located", F.lit(batch)).alias("located"), F.col("_key").isNull().alias("is_new")
        )

    def _consume(self) -> None:
        kept = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            schema = "_key string, _digest string, _points long, doc_id long, batch string, located string"
            rows = self.spark.readStream.schema(schema).parquet(self._intake())
            state = rows.groupBy("_key").agg(
                F.max(place(F.col("batch"))).alias("best"),
                F.count(F.lit(1)).alias("n"),
                F.max("_digest").alias("_digest"),
                F.max("located").alias("located"),
            )
            log = f"{self.folder}/log"

            def append(changes: DataFrame, version: int) -> None:
                changes.write.mode("overwrite").parquet(f"{log}/version={version}")

            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True)
                .foreachBatch(append)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in kept.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def rows(self) -> DataFrame:
        """``_key, doc_id`` of every row taken in."""
        return self.spark.read.schema("_key string, doc_id long").parquet(self._intake())

    def entries(self) -> DataFrame:
        """``_key, _digest, keep_id, keep_batch, group_size, located``: the latest state per text."""
        log = self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")
        last = log.groupBy("_key").agg(F.max_by(F.struct("best", "n", "_digest", "located"), "version").alias("s"))
        return last.select(
            "_key",
            F.col("s._digest").alias("_digest"),
            F.col("s.best.doc_id").alias("keep_id"),
            F.col("s.best.batch").alias("keep_batch"),
            F.col("s.n").alias("group_size"),
            F.col("s.located").alias("located"),
        )


_LOG = (
    "_key string, best struct<_points: long, known: boolean, rank: long, batch: string, doc_id: long>, n long, _digest string, located string, version long"
)


def _survey(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[Ledger, DataFrame]:
    """The ledger of one batch and, stored, ``doc_id, _digest, keep_id, group_size`` of every row."""
    spark = docs.sparkSession
    ledger = Ledger(spark, scratch_path(spark, "ledger"), digest, keep_texts=False)
    ledger.add(docs)
    entries = stage(ledger.entries(), "entries")
    found = spread_join(ledger.rows(), entries, ["_key"], F.col("doc_id"), "group_size")
    return ledger, stage(found.select("doc_id", "_digest", "keep_id", "group_size"), "verdicts")


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by digest and salt: digests of rows unlike the first of their run, and every run's first text where a digest has several."""
    run, first = None, None
    for batch in batches:
        digests, salts, several, plain = (batch.column(c).to_pylist() for c in ("_digest", "_salt", "_salts", "_plain"))
        found, heads = [], []
        for digest, salt, many, text in zip(digests, salts, several, plain, strict=True):
            if run != (digest, salt):
                run, first = (digest, salt), text
                if many > 1:
                    found.append(digest)
                    heads.append(text)
            elif text != first:
                found.append(digest)
                heads.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(heads, pa.string())], ["_digest", "_head"])


def _several_texts(plain: DataFrame, marks: DataFrame) -> DataFrame:
    """``_digest`` of digests that stand for several texts among ``plain``, by comparing full bytes.

    Texts meet once, sorted by digest; each is compared with the first of its run, so a task
    holds two texts at a time. A hot digest's rows are dealt over salts, each with a run of
    its own, and the runs' first texts are compared afterwards.
    """
    counts = marks.groupBy("_digest").agg(F.count(F.lit(1)).alias("n"))
    # Stored, so that its true size decides how texts are joined to it: as a rule there are few.
    hot = stage(
        counts.where(F.col("n") > ROWS_PER_SALT).select("_digest", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("_salts")), "hot-digests"
    )
    dealt = plain.join(hot, "_digest", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_points"), F.col("_salts")).cast("int"))
    runs = dealt.select("_digest", "_salt", "_salts", "_plain").repartition("_digest", "_salt").sortWithinPartitions("_digest", "_salt")
    seen = stage(runs.mapInArrow(_unlike, "_digest string, _head string"), "unlike")
    # Two first texts that differ, or a row unlike its run's first, which came without a text.
    collided = seen.groupBy("_digest").agg(F.min("_head").alias("a"), F.max("_head").alias("b"), F.count_if(F.col("_head").isNull()).alias("n"))
    return collided.where("n > 0 or a != b").select("_digest")


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = digest) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when identical without blanks; null counts as empty. The row with most
    code points stays, then the one with the smallest id (null last). Rows that repeat the id
    of the row that stays are all marked ``kept``; ``dedup`` leaves one of them. An empty
    table gives no rows; other columns are ignored.
    """
    _, found = _survey(docs.select("doc_id", "text"), digest)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = digest) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; one row of each group."""
    ledger, found = _survey(docs.select("doc_id", "text"), digest)
    stays = (
        found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("_digest").alias("_of"), F.col("doc_id").alias("_id"))
        .agg(F.count(F.lit(1)).alias("_same"))
    )
    # Stored: narrow, read up to three times, and its true size decides how the rows meet it.
    stays = stage(stays, "stays")
    # Each row travels once, inside its struct.
    rows = ledger.marked(docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")

    def staying(some: DataFrame) -> DataFrame:
        return rows.join(some, (F.col("_digest") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    several = stays.where("_same > 1")
    if several.isEmpty():
        return staying(stays).select("_row.*")
    # Rows that repeat id and text: only they are compared with each other.
    chosen = keep_first(staying(several), ["_of", "_id"], [F.desc("_points"), F.col("_row.text")])
    return staying(stays.where("_same = 1")).unionByName(chosen).select("_row.*")


# DuckDB form of duplicates().
ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
