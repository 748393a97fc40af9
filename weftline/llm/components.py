"""Connected components by alternating large and small stars, each a join and an aggregate; what a round leaves is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize


def _met(edges: DataFrame, facts: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Edges with their node's m, from one row (a, m, n) a node, n its number of edges: all by broadcast if nodes are few, else those of at
    least one in ``most`` edges, which are at most ``most`` nodes."""
    facts = materialize(facts, "cc-facts")
    fewer = facts.drop("n")
    if facts.limit(most + 1).count() <= most:
        return edges.join(F.broadcast(fewer), "a")
    hot = F.broadcast(facts.filter(F.col("n") >= facts.agg(F.sum("n")).first()[0] / most).drop("n"))
    return edges.join(hot, "a").unionByName(edges.join(hot.select("a"), "a", "left_anti").join(fewer, "a"))


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): (node, root) for every node that is not its component's smallest, the root being that one.

    Each round at least halves the distance to the root in practice. Minima are taken before rows move, and edges of nodes that have very
    many meet theirs by broadcast.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = _met(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc-large")
        pairs = _met(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = pairs.select("a", F.col("m").alias("b")).unionByName(pairs.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialize(small, "cc-edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
