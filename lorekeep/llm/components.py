"""Connected components of an undirected graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, written

def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node but the roots.

    ``edges`` has the columns ``a`` and ``b``. Each round hangs every node's neighbours on the smallest
    node it sees; the rounds grow with the logarithm of the longest path. Minima are aggregated before they
    are shuffled, and a node's links meet its minimum in several tasks, as a root has as many as its component."""
    stars = written(
        edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), "edges"
    )
    state = _state(stars)
    while state[0]:
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(least.withColumnRenamed("m", "b")).where("a <> b").distinct(), "stars")
        discard(stars, large)
        stars, before, state = after, state, _state(after)
        if state == before:
            break
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots.stored_at = stars.stored_at
    return roots
