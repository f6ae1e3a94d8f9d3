"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Each node tied once, and to a node that is tied to nothing."""
    twice = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
    return twice.unionByName(chained).isEmpty()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b) but those that are their component's smallest id.

    Alternating large and small stars: the diameter shrinks by a constant factor each
    round, every round is joins and sums by key, and its result is a table in the
    shared folder, so that lost executors cost one round at most. Edges from a node to
    itself and repeated edges do no harm.
    """
    stars = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges"
    )
    while not _is_stars(stars):
        stars = written(_small_star(_large_star(stars)), f"{name}-round")
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
