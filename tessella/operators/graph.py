"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of the nodes of (a long, b long) edges, the component being its smallest id; repeats and loops are allowed.

    Each round sends every node's smallest neighbour to its larger ones and then every node to the smallest of its smaller ones, so paths
    shrink by half or better. Only minima travel: a hub's neighbours are reduced in each task before the shuffle, and the joins back are
    plain shuffles that adaptive execution splits. Ends when a round changes nothing.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most):
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        state = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components: no fixpoint after {most} rounds")
