"""Semantic duplicates: groups of rows of one cluster that a chain of cosines of at least tau links, one row of each kept.

The join is exact. Equal vectors are folded first. A cluster's rows are laid out by cells of their angles to a few pivots and cut into blocks
of a bounded size; two blocks are compared only if, for every pivot, their ranges of angles come within the angle of tau (angles on the
sphere obey the triangle inequality). Groups are found inside blocks first; of a pair of blocks a spanning forest of groups leaves the task, never all links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import draw_key
from tessella.functions.vectors import PLACES, dot
from tessella.operators import graph
from tessella.operators.cluster import prototypes_by
from tessella.plans.lineage import cut, ranked, ranked_within

BLOCK = 1024
PIVOTS = 8
#: Angles are bounds only: they are widened by more than their rounding and that of cosines.
SLACK = 1e-6


def angles(v: Column | str, pivots: Column | str) -> Column:
    return F.transform(pivots, lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(v, p)))))


def pivots_of(rows: DataFrame, most: int = PIVOTS) -> DataFrame:
    """One row with an array of at most `most` vectors: the cluster sums of the first clusters by size, as unit vectors. Any pivots give right results."""
    found = prototypes_by(rows.select("cluster", "v"), "cluster").orderBy(F.desc("size"), "proto_id").limit(most)
    return found.agg(F.collect_list(F.struct("proto_id", "centroid")).alias("p")).select(F.transform(F.array_sort("p"), lambda e: e["centroid"]).alias("pivots"))


def reach(tau: float) -> float:
    """The largest angle of two vectors whose rounded cosine is at least tau, widened by the rounding of angles."""
    return math.acos(max(-1.0, tau - 10.0**-PLACES)) + SLACK


def blocks(rows: DataFrame, pivots: DataFrame, tau: float, size: int = BLOCK) -> DataFrame:
    """Rows (id, cluster, v) with their angles to the pivots and their block: runs of at most `size` rows of a cluster, by cells as wide as the reach of tau.

    Cells are ordered by the first pivot's angle, then the next one's, so a block is narrow in the first few of them.
    """
    each = rows.crossJoin(F.broadcast(pivots)).withColumn("angles", angles("v", "pivots")).drop("pivots")
    held = cut(each.withColumn("__cells", F.transform("angles", lambda a: F.floor(a / reach(tau)))))
    n = held.count()
    placed = cut(ranked(held, [F.asc("cluster"), F.asc("__cells"), F.asc("id")], "__place", n))
    inside = ranked_within(placed, "cluster", "__place", "__at", n)
    return inside.withColumn("block", F.floor((F.col("__at") - 1) / size)).drop("__cells", "__place", "__at")


def block_pairs(rows: DataFrame, tau: float) -> DataFrame:
    """(cluster, a, b) of blocks a < b of one cluster that no pivot tells apart. The table has a row a block, so it is small beside the rows."""
    far = reach(tau)
    ends = rows.select("cluster", "block", F.posexplode("angles").alias("p", "angle")).groupBy("cluster", "block", "p").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    box = cut(ends.groupBy("cluster", "block").agg(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("box")))
    a, b = box.select("cluster", F.col("block").alias("a"), F.col("box").alias("x")), box.select("cluster", F.col("block").alias("b"), F.col("box").alias("y"))
    apart = F.exists(F.zip_with("x", "y", lambda s, t: (t["lo"] - s["hi"] > far) | (s["lo"] - t["hi"] > far)), lambda out: out)
    return a.join(b, "cluster").where((F.col("a") < F.col("b")) & ~apart).select("cluster", "a", "b")


def grouped(close: np.ndarray) -> np.ndarray:
    """Of each node of a graph, given as a symmetric matrix, the smallest node that it is connected to."""
    label = np.arange(len(close))
    while True:
        least = np.minimum(label, np.where(close, label[None, :], len(label)).min(axis=1, initial=len(label)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the edges (left, right) between any node numbers."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = parent[up]
            i = up
        return i

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def links(rows: DataFrame, tau: float, size: int = BLOCK) -> DataFrame:
    """(a, b) edges that connect the same rows as all pairs (id, cluster, v) of one cluster with a cosine of at least tau do.

    First each block by itself: its rows are named by the smallest id that they reach in it. Then pairs of blocks, which link names alone: a
    spanning forest of the names that meet, at most one edge a name.
    """
    placed = cut(blocks(rows, pivots_of(rows), tau, size)).select("id", "cluster", "block", "v", "angles")

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, ids = np.stack(part["v"]), part["id"].to_numpy()
        return pd.DataFrame({"id": ids, "name": ids[grouped(np.round(x @ x.T, PLACES) >= tau)]})

    named = cut(placed.groupBy("cluster", "block").applyInPandas(inside, "id long, name long"))
    pairs = cut(block_pairs(placed, tau))
    narrow = cut(placed.drop("angles").join(named, "id"))

    def across(part: pd.DataFrame) -> pd.DataFrame:
        one, two = part[part["side"] == 0], part[part["side"] == 1]
        close = np.round(np.stack(one["v"]) @ np.stack(two["v"]).T, PLACES) >= tau
        i, j = np.nonzero(close)
        met = np.unique(np.stack((one["name"].to_numpy()[i], two["name"].to_numpy()[j]), axis=1), axis=0)
        return pd.DataFrame(forest(met[:, 0], met[:, 1]), columns=["a", "b"]).astype("int64")

    def crossed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Edges between names of the pairs' blocks. What a row reaches already it is not compared with: rows go to no block that is all of their name."""
        whole = cut(rows.groupBy("cluster", "block").agg(F.when(F.min("name") == F.max("name"), F.min("name")).alias("only")))
        told = pairs.join(whole.select("cluster", F.col("block").alias("a"), F.col("only").alias("only_a")), ["cluster", "a"]).join(whole.select("cluster", F.col("block").alias("b"), F.col("only").alias("only_b")), ["cluster", "b"])
        told = cut(told.where(~F.coalesce(F.col("only_a") == F.col("only_b"), F.lit(False))))

        def side(own: str, other: str, n: int) -> DataFrame:
            met = rows.join(told.withColumnRenamed(own, "block"), ["cluster", "block"]).where(~F.coalesce(F.col("name") == F.col(f"only_{other}"), F.lit(False)))
            return met.select("cluster", F.col("block").alias(own), other, F.lit(n).alias("side"), "name", "v")

        return side("a", "b", 0).unionByName(side("b", "a", 1)).groupBy("cluster", "a", "b").applyInPandas(across, "a long, b long")

    # Blocks next to each other first: where they are dense, most names are one by then, and few rows are left for the other pairs.
    inner = named.where("id <> name").select(F.col("id").alias("a"), F.col("name").alias("b"))
    near = cut(crossed(narrow, pairs.where("b = a + 1")))
    joined = cut(graph.components(near))
    renamed = cut(narrow.join(joined.withColumnRenamed("id", "name"), "name", "left").withColumn("name", F.coalesce("component", "name")).drop("component"))
    return inner.unionByName(near).unionByName(crossed(renamed, pairs.where("b > a + 1")))


def duplicates(rows: DataFrame, tau: float, size: int = BLOCK) -> DataFrame:
    """(row_idx, component) of every row of (row_idx, cluster, v), the component being the smallest row_idx of its group.

    Equal vectors of a cluster are one row of the join. A row alike to no other is its own group; equal row_idx must not occur.
    """
    if not 0.0 < tau <= 1.0:
        raise ValueError(f"tau must be in (0, 1], got {tau}")
    held = cut(rows.select("row_idx", F.coalesce(F.col("cluster"), F.lit(-1)).alias("cluster"), "v"))
    folded = held.groupBy("cluster", "v").agg(F.min("row_idx").alias("id"))
    found = graph.components(links(cut(folded), tau, size))
    joined = held.join(folded, ["cluster", "v"]).select("row_idx", "id").join(found, "id", "left")
    return joined.select("row_idx", F.coalesce("component", "id").alias("component"))


def keep_one(rows: DataFrame, tau: float, keep: str = "hard", size: int = BLOCK) -> DataFrame:
    """Rows (row_idx, cluster, distance, v) with component, its size and kept: the farthest from the prototype of each group (hard), or the nearest (easy), the first on ties."""
    if keep not in ("hard", "easy"):
        raise ValueError(f"keep must be hard or easy, got {keep!r}")
    # Ranked rows lie in one partition, and are read for the groups and for the rows.
    rows = cut(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "row_idx"))
    held = rows.join(duplicates(rows, tau, size), "row_idx")
    distance = F.col("distance") if keep == "easy" else -F.col("distance")
    # One row a group comes back; the groups' minima are made in each task first.
    best = held.groupBy("component").agg(F.min(F.struct(distance.alias("d"), "row_idx"))["row_idx"].alias("best"), F.count(F.lit(1)).alias("group_size"))
    return held.join(best, "component").withColumn("kept", F.col("row_idx") == F.col("best")).drop("best")


def choose(rows: DataFrame, budget: int, seed: int, tau: float, keep: str = "hard", size: int = BLOCK) -> DataFrame:
    """keep_one() rows with keep_rank and selected: the kept rows by the seeded draw, then, where they are too few, the others by it."""
    found = cut(keep_one(rows, tau, keep, size))
    n = found.count()
    if budget < 0 or budget > n:
        raise ValueError(f"budget={budget} is out of range")
    order = ranked(found.withColumn("__key", draw_key(seed, F.col("image_id"))), [F.desc("kept"), F.asc("__key"), F.asc("row_idx")], "keep_rank", n)
    return order.withColumn("selected", F.col("keep_rank") <= budget).drop("__key")
