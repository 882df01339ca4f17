"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Scratch, written


def connected_components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of each node of
    ``links`` (columns a and b) that is not the smallest of its component.

    Links of a node to itself and repeated links are harmless; null ends are dropped.
    Each step is written, so a lost executor costs no more than one step, and deleted
    after the next one; the answer is written by ``keep``. A node
    with very many links is met by partial minima and by joins that can be split.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", links.count())
        mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        seen = edges.agg(mark.alias("m")).first()["m"]
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
            edges = scratch.written(small.distinct(), "links", seen[0])  # stars have no more links than there were
            scratch.drop_before(1)
            now = edges.agg(mark.alias("m")).first()["m"]
            if now == seen:
                return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
            seen = now
