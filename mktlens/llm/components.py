"""Connected components of a table of links, by alternating star steps, without a loop over nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour that is greater than a node hangs on the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b")))


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): every linked node but the smallest of its component, with that smallest node.

    ``edges`` (a, b): links in any direction, repeats allowed. The type of the
    nodes only needs an order. Each step is written to the shared folder.
    """
    now = kept(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            return now
        seen = mark
        now = kept(_small(_large(now).distinct()).distinct(), "links")
