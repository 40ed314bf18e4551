"""Connected components of a graph too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node that links reach) of each node in `links` (a, b).

    Each round takes the least root among the neighbours', then the root's own root, so that paths shorten by halves.
    Roots are checkpointed, in as many partitions as their rows need; only counts come to the driver.
    """
    links = links.select("a", "b")
    both = runtime.fitted(runtime.checkpoint(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    parts = max(1, both.rdd.getNumPartitions())
    roots = runtime.checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")).coalesce(parts))
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").coalesce(parts).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = roots.withColumnRenamed("root", "was").join(near, "node").select("node", F.least("was", "near").alias("up"), "was").coalesce(parts)
        jump = least.join(roots.select(F.col("node").alias("up"), F.col("root").alias("over")), "up", "left")
        new = runtime.checkpoint(jump.select("node", F.least("up", F.coalesce("over", "up")).alias("root"), "was").coalesce(parts))
        changed = not new.where(F.col("root") != F.col("was")).isEmpty()
        roots = new.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
