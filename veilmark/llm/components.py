"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step hangs neighbours below the smallest id around them; the edges become stars around the smallest id of each
component. Every step is one combinable minimum and one join, both by vertex. The centre of a star may have very many
neighbours: in the step that reads edges both ways the minima are a checkpoint of their own, so that the join is of two
plain exchanges and Spark can split the centre's edges over tasks. In the other step a vertex only has the few centres
around it. Each step is a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than a vertex move below the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m")))
    moved = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours move below the least of them; an edge goes from `a` to a smaller `b`."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("u"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each vertex of `edges` (a, b) the smallest id that links reach.

    Loops, repeated and null ends don't count; without links there are no rows.
    """
    now = checkpoint(edges.where("a <> b").select("a", "b").distinct())
    while True:
        now = checkpoint(_small_star(checkpoint(_large_star(now))))
        # done when edges are stars: no vertex has two centres, none is below a centre and a centre too
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("below"), F.lit(0).alias("centre")).union(now.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("centre").alias("centre")).where("below + centre > 1 AND below > 0")
        if open_.isEmpty():
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
