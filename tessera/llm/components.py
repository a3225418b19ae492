"""Connected components by alternating large-star and small-star steps, all joins and aggregations of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, freeing_shuffles


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b, after one step: neighbours above (large) or all below (small) go to the least neighbour."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node that it is connected with.

    Loops and repeated edges do not matter; nulls must be absent.  Every round ends in a table in the shared folder, which replaces the last round's.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while not _done(now):
        now = scratch.write(_stars(_stars(now, True), False), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether edges (a, b) are stars: every a has one b, which is no a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    with freeing_shuffles(edges.sparkSession):
        sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return sums.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
