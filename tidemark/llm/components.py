"""Connected components of an edge table by alternating large and small stars.

Every round is a pair of joins and minimum-aggregations; joins salt the hubs of stars; edges stay in tables of the shared folder,
and only whether any node is left to move reaches the driver. At the end each node points to the smallest node of
its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, salted_join

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = salted_join(both.where("b > a"), least, "a", "b", counted=e.select(F.col("b").alias("a")))
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame, counted: DataFrame) -> DataFrame:
    """counted: holds each node a as often as e at least, and is cheaper to count."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    met = salted_join(e, least, "a", "b", counted=counted)
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and that one none."""
    ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each node a but the smallest of a component, with that smallest b. links: columns a, b (bigint)."""
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            return e
        # a large star gives each node no more edges to smaller ones than it had
        e = materialize(_small_star(_large_star(e), e), "edges")
    raise RuntimeError("components did not settle")
