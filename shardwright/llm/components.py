"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour; after a few rounds every node points
at the smallest id of its component.  All state is a table in the shared folder; the driver sees
one checksum a round.  The smallest neighbours are written before they are joined back, so both
sides of the join are plain shuffles that AQE may split at a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import stored


def _star(edges: DataFrame, label: str) -> DataFrame:
    """edges(u, v): v and u itself are joined to the smallest of u's neighbours and u."""
    least = stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), label)
    return edges.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (node, component) for every node of an edge, component: the least id."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    before = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.sum("v")).collect()[0]
        if seen == before or seen[0] == 0:
            break
        before = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-least").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "cc-large")  # every edge points from the greater to the smaller
        small = _star(large, "cc-least")
        own = small.select("u", F.col("m").alias("v"))
        rest = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(own.union(rest).where("u > v").distinct(), "cc-edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
