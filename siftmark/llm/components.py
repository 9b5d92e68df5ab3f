"""Connected components by alternating large and small stars, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import growing, join_spread
from siftmark.session import materialize


def _state(edges: DataFrame) -> tuple:
    """Two sums that change when the set of edges does."""
    low = F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("_h", 32)
    return tuple(
        edges.select(F.xxhash64("a", "b").alias("_h")).agg(F.count("*"), F.sum(low), F.sum(high)).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    moved = join_spread(both.where("v > u"), growing(least), ["u"])
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = join_spread(edges, growing(least), ["b"])
    pairs = moved.select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), a < b; the root is the
    smallest node of its component and has a row too. Rounds grow with the
    logarithm of the longest chain; each is written to the shared folder."""
    edges = materialize(edges, "edges")
    state = _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return (
        edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        .unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    )
