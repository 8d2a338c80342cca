"""Connected classes of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import spread_join
from peneira.session import stage

MAX_ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label`` for every linked node; nodes of a class share the label, one of its nodes.

    Each round every node points at the neighbour (or itself) first in a hashed order that
    changes with the round, and links are redrawn between what they point at. The order is
    random, so long chains shrink by a constant share and rounds grow with the logarithm of
    the links; links and nodes left get fewer each round. Tables of every round are written
    to the shared folder, so a lost executor costs a task.
    """
    edges = stage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        if len(steps) == MAX_ROUNDS:
            raise RuntimeError(f"classes did not settle in {MAX_ROUNDS} rounds")
        turn = F.lit(len(steps))
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(
            F.min(F.struct(F.xxhash64("b", turn).alias("h"), "b")).alias("best"), F.count(F.lit(1)).alias("degree")
        )
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("b"))
        points = stage(first.select("a", F.least("best", own)["b"].alias("to"), "degree"), "points")
        steps.append(points)
        one = spread_join(edges, points, ["a"], F.col("b"), "degree").select("b", F.col("to").alias("x"))
        ends = points.select(F.col("a").alias("b"), "to", "degree")
        two = spread_join(one, ends, ["b"], F.col("x"), "degree").select("x", F.col("to").alias("y"))
        ordered = two.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        edges = stage(ordered.distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[-1].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for points in reversed(steps[:-1]):
        later = labels.select(F.col("node").alias("to"), F.col("label").alias("final"))
        labels = points.join(later, "to", "left").select(F.col("a").alias("node"), F.coalesce("final", "to").alias("label"))
        labels = stage(labels, "labels")
    return labels
