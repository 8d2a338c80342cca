"""Ids the message store already holds, kept so that asking for some of them moves none of the others.

Ids lie in hash buckets, sorted, and beside them a Bloom filter of 64-bit words, in buckets of
their own. A batch is dealt to the buckets and meets files that already lie there: neither
ids nor words are shuffled, and where the filter knows none of a batch's ids the ids are not
read at all.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.session import stage

BUCKETS = 64
# Ids per filter word; with four bits an id, about one new id in a hundred is looked up in vain.
IDS_PER_WORD = 6
_SHIFTS = (0, 6, 12, 18)


def _mask(message_id: Column) -> Column:
    """Four bits of a word, from parts of a second hash."""
    second = F.xxhash64(message_id, F.lit(1))
    bits = F.lit(0).cast("long")
    for shift in _SHIFTS:
        at = F.shiftright(second, shift).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return bits


@dataclass(frozen=True)
class KnownIds:
    """Stored ids under ``path``; ``open`` makes one for a session."""

    spark: SparkSession
    path: str
    buckets: int
    words: int

    @property
    def _name(self) -> str:
        return "known_ids_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    def _table(self, kind: str, columns: str, key: str) -> str:
        name = f"{self._name}_{kind}"
        self.spark.sql(
            f"create table if not exists {name} ({columns}) using parquet "
            f"clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.path}/{kind}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def ids(self) -> DataFrame:
        return self.spark.read.table(self._table("ids", "message_id string, batch string", "message_id"))

    def _words(self) -> DataFrame:
        """One row per filter word: what all batches have set in it."""
        stored = self.spark.read.table(self._table("words", "slot long, bits long, batch string", "slot"))
        return stored.groupBy("slot").agg(F.bit_or("bits").alias("bits"))

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("message_id"), F.lit(self.words)).alias("slot")

    def suspects(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that may be stored; an id that is stored is always among them."""
        asked = ids.select("message_id", self._slot(), _mask(F.col("message_id")).alias("mask"))
        met = asked.repartition(self.buckets, "slot").join(self._words(), "slot")
        return met.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("message_id")

    def known(self, ids: DataFrame, batch: str | None = None) -> DataFrame:
        """Those of ``ids`` that are stored, by other batches than ``batch`` where it is given."""
        maybe = stage(self.suspects(ids), "suspects")
        if maybe.isEmpty():
            return maybe
        stored = self.ids().where(F.lit(True) if batch is None else F.col("batch") != batch).select("message_id")
        return maybe.repartition(self.buckets, "message_id").join(stored, "message_id", "left_semi")

    def unseen(self, new: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of ``new`` whose id is not ``known``; rows without an id stay.

        Only ids go to the store. The way back meets the batch's known ids alone.
        """
        asked = new.select("message_id").where("message_id is not null").distinct()
        return new.join(self.known(asked, batch), "message_id", "left_anti")

    def add(self, ids: DataFrame, batch: str = "") -> None:
        """Store ``ids``; adding a batch again changes no answer."""
        rows = ids.select("message_id").where("message_id is not null").distinct().withColumn("batch", F.lit(batch))
        table = self._table("ids", "message_id string, batch string", "message_id")
        # Dealt as the buckets are, so that every task writes one file.
        rows.repartition(self.buckets, "message_id").sortWithinPartitions("message_id").write.insertInto(table)
        words = rows.groupBy(self._slot()).agg(F.bit_or(_mask(F.col("message_id"))).alias("bits")).withColumn("batch", F.lit(batch))
        table = self._table("words", "slot long, bits long, batch string", "slot")
        words.repartition(self.buckets, "slot").sortWithinPartitions("slot").write.insertInto(table)


def open_ids(spark: SparkSession, path: str, expected: int = 1_000_000, buckets: int = BUCKETS) -> KnownIds:
    """The store under ``path``, made on first use for about ``expected`` ids.

    Number of buckets and words are fixed then. More ids than expected stay right: the filter lets
    more of them through to the look-up.
    """
    settings = f"{path.rstrip('/')}/settings"
    try:
        kept = spark.read.schema("buckets int, words long").parquet(settings).first()
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        kept = None
    if kept is None:
        kept = {"buckets": buckets, "words": max(buckets, -(-expected // IDS_PER_WORD))}
        spark.createDataFrame([(kept["buckets"], kept["words"])], "buckets int, words long").write.parquet(settings)
    return KnownIds(spark, path.rstrip("/"), kept["buckets"], kept["words"])
