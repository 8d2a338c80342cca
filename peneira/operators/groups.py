"""Merge duplicate links into groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.operators.keyed import spread_lookup
from peneira.session import stage
from peneira.sources import versions

MAX_ROUNDS = 50
# Ids whose links a task holds at a time; it then sends on what it has.
HELD_IDS = 200_000
_PLAIN_IDS = {"string", "bigint", "int", "smallint", "tinyint"}


def spanning(links: DataFrame) -> DataFrame:
    """Distinct links ``a, b`` that join the same ids as ``links`` (no null, none of an id to itself).

    A task sends on one link per id it meets, to the smallest one that its links join it to, instead of all
    links, whose number may grow with the square of a group; that is before anything is shuffled.
    """
    held_ids = HELD_IDS

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict = {}
        schema = None

        def first(i):
            while lead[i] != i:
                lead[i] = i = lead[lead[i]]
            return i

        def found() -> pa.RecordBatch:
            ends = [(i, first(i)) for i in lead]
            a, b = zip(*(e for e in ends if e[0] != e[1]), strict=True)
            lead.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b), schema.types, strict=True)], schema.names)

        for batch in batches:
            schema = batch.schema
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = first(lead.setdefault(a, a)), first(lead.setdefault(b, b))
                if a < b:
                    lead[b] = a
                elif b < a:
                    lead[a] = b
            if len(lead) >= held_ids:
                yield found()
        if lead:
            yield found()

    types = {t for _, t in links.dtypes}
    if len(types) == 1 and types <= _PLAIN_IDS:
        links = links.mapInArrow(forest, links.schema)
    return links.distinct()


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; every step keeps the connected parts.

    Large star: each node links its larger neighbours to the smallest node it knows. Small
    star: each node links itself and its smaller neighbours to the smallest of them.
    """
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    large = (
        _attach_minimum(both)
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .where("a != b")
        .distinct()
    )
    down = stage(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
    small = _attach_minimum(down)
    return (
        small.select(F.col("b").alias("a"), F.col("least").alias("b"))
        .union(small.select("a", F.col("least").alias("b")))
        .where("a != b")
        .distinct()
    )


def _attach_minimum(directed: DataFrame) -> DataFrame:
    """Directed edges a -> b with the smallest of a and all its b; the edges of a hub are dealt over tasks."""
    least = directed.groupBy("a").agg(F.least("a", F.min("b")).alias("least"), F.count(F.lit(1)).alias("degree"))
    return spread_lookup(directed, stage(least, "least"), ["a"], F.col("b"), "degree").drop("degree")


def _fingerprint(edges: DataFrame) -> tuple:
    """Size and two order-free hashes of the edge set, aggregated without a shuffle of rows."""
    code = F.xxhash64("a", "b")
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(code), F.sum(code.cast("decimal(20,0)"))
        ).first()
    )


def dup_groups(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """``id, group_id`` for every linked id; the group id is its smallest member.

    Rounds of star contraction shrink path lengths geometrically, so the number of rounds
    grows with the logarithm of the longest chain. Each round is a join and an aggregation;
    tables in the shared folder cut the lineage. They give the optimizer true sizes, which
    checkpoints do not: those keep estimates that are multiplied from round to round.
    """
    edges = stage(spanning(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b")), "edges")
    after = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        if not after[0]:  # no links, so no groups
            break
        edges = stage(_star_round(edges), "edges")
        before, after = after, _fingerprint(edges)
        if before == after:
            break
    else:
        raise RuntimeError(f"groups did not settle in {MAX_ROUNDS} rounds")
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("group_id")).distinct()
    return members.union(roots)


class StoredGroups:
    """Groups under ``path`` that batches of new links extend.

    A member keeps the label it was first given; when groups meet, only the labels that lose
    their place are written anew, so a batch costs what it holds and not what is stored: members are
    read beside the batch's ids, never shuffled or rewritten. ``labels`` leads from a label to the
    group's smallest member in one step.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type

    def members(self) -> DataFrame:
        """``id, label`` of every id some link named."""
        schema = f"id {self.id_type}, label {self.id_type}"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/members")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def labels(self) -> DataFrame:
        """``label, group_id`` of labels whose group has been joined to another."""
        if not versions.latest_version(self.spark, f"{self.path}/labels"):
            return self.spark.createDataFrame([], f"label {self.id_type}, group_id {self.id_type}")
        return versions.read_version(self.spark, f"{self.path}/labels")

    def _resolved(self, members: DataFrame) -> DataFrame:
        found = spread_lookup(members, self.labels(), ["label"], F.col("id"))
        return found.select("id", F.coalesce("group_id", "label").alias("group_id"))

    def groups(self) -> DataFrame:
        """``id, group_id`` of every id linked so far, as ``dup_groups`` of all links gives them."""
        return self._resolved(self.members())

    def add(self, pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> None:
        """Take in links; a link with a null end, or of an id to itself, says nothing.

        The ends of a link are replaced by their groups' labels, and only labels are joined to
        groups anew. Labels are written before members: an add that is broken off leaves true
        statements, and the same links added again complete it.
        """
        links = stage(
            spanning(pairs.select(F.col(a).cast(self.id_type).alias("a"), F.col(b).cast(self.id_type).alias("b")).where("a != b")), "links"
        )
        ends = stage(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "link-ends")
        known = stage(self.members().join(ends, "id", "left_semi"), "known-members")
        old = self._resolved(known).groupBy("id").agg(F.min("group_id").alias("old"))
        roots = stage(ends.join(old, "id", "left").select("id", F.coalesce("old", "id").alias("root"), F.col("old").isNull().alias("is_new")), "roots")
        for end in ("a", "b"):
            named = roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
            links = spread_lookup(links, named, [end], F.col("b" if end == "a" else "a"))
        met = dup_groups(links, "root_a", "root_b").where("id != group_id")
        moved = stage(met.select(F.col("id").alias("label"), "group_id"), "moved-labels")
        # Ids that are new have no label to move: they are given the last one below.
        stored = roots.where("not is_new").select(F.col("root").alias("label")).distinct()
        onward = moved.select(F.col("label").alias("group_id"), F.col("group_id").alias("next"))
        led = self.labels().join(onward, "group_id").select("label", F.col("next").alias("group_id"))
        changed = stage(moved.join(stored, "label", "left_semi").unionByName(led), "changed-labels")
        versions.merge(changed, f"{self.path}/labels", ["label"])
        fresh = roots.where("is_new").select("id").join(moved.select(F.col("label").alias("id"), F.col("group_id")), "id", "left")
        fresh.select("id", F.coalesce("group_id", "id").alias("label")).write.mode("append").parquet(f"{self.path}/members")
