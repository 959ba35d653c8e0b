"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _relabel(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """(u, v) joined with the least neighbour m of u; the minimum is combined before the shuffle."""
    least = others.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint, not null); the component is its least node.

    Self-loops, repeated and reversed edges are allowed. Rounds grow with the logarithm of the longest path; each is
    cut off into the shared folder.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(now)
    while state[0]:
        # large star: each node's greater neighbours go to the least of its neighbours and itself
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _relabel(now.select(F.col("b").alias("u"), F.col("a").alias("v")), both)
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its lesser neighbours go to the least of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _relabel(down, down)
        moved = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(moved.filter("a <> b").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
