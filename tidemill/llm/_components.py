"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._spark import discard, stored


def _pointing(edges: DataFrame) -> bool:
    """Whether each node points at one node that itself points at none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for each node of edges (columns a and b, long).

    Alternates large-star and small-star rounds until every node points at its component.
    The least neighbours are written before they are joined, so that the join may split
    the many edges of a hub. Loops and nulls are left out; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _pointing(now):
        both = now.union(now.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        first, least = least, stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        before, now = now, stored(small)
        discard(before, first, large, least)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())
