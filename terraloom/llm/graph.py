"""Connected components over edge tables, wholly distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import common


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, both.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = down.join(least, down.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an undirected edge table (a, b): the least node it reaches.

    Each round is written to the shared folder, so a lost executor costs one round. Hot nodes are reduced to
    their minimum before anything is joined to them; no neighbour list is ever gathered. Rounds grow with
    the logarithm of the node count.
    """
    tidy = lambda e: e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = common.written(tidy(edges), "edges")
    before = sign(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        step = common.written(tidy(_small(tidy(_large(now)))), "stars")
        after = sign(step)
        common.discard(now)
        now = step
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
