"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def components(links: DataFrame) -> DataFrame:
    """u, v (longs) -> node, root: every node of a link with the least node of its component.

    Each round takes the least root among a node's neighbours, then that root's own root, so paths shrink by half or
    more; minima combine before the exchange, and rounds are written, so they survive the loss of executors.
    """
    both = written(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct(), "links")
    roots = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "roots")
    while True:
        of = roots.select(F.col("node").alias("v"), "root")
        near = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("least"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "least").alias("r"))
        jump = roots.select(F.col("node").alias("r"), F.col("root").alias("far"))
        then = written(step.join(jump, "r", "left").select("node", F.col("root").alias("was"), F.least("r", F.coalesce("far", "r")).alias("root")), "roots")
        if then.where("was <> root").isEmpty():
            return then.select("node", "root")
        roots = then.select("node", "root")
