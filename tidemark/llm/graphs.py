"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours instead."""
    both = links.union(links.select("v", "u"))
    # written, so that the join deals out both sides itself and may split the links of a hub
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked to the least of them instead."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """u, v (longs) -> node, root: for each node of a link that isn't the least of its component, that least node.

    Neighbours are never gathered in a list: each round takes minima, which combine before the shuffle, and joins,
    which the planner may split. Rounds are written to the shared folder and grow with the logarithm of the
    longest path. Self links and nulls are ignored.
    """
    now, mark = materialize(links.select("u", "v").where("u <> v").distinct(), "links"), None
    while True:
        large = materialize(_large_star(now), "links")
        then = materialize(_small_star(large), "links")
        discard(large)
        discard(now)
        found = tuple(then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        now = then
        if found == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = found
