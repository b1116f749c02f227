"""Exact-budget pruning: keep priority, cluster quotas and the global fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut, ranked, ranked_within

KEEP = ("hard", "easy")


def check(n: int, budget: int, keep: str, balance: float) -> None:
    if keep not in KEEP:
        raise ValueError(f"{keep!r} is no way to keep rows; there are {KEEP}")
    if not 0 <= budget <= n:
        raise ValueError(f"a budget of {budget} rows does not fit a pool of {n}")
    if not 0.0 <= balance <= 1.0:
        raise ValueError(f"balance={balance} is no share from 0 to 1")


def priority(keep: str) -> list:
    """Hard keeps the farthest first, easy the nearest; ties by row_idx."""
    return [F.desc("distance") if keep == "hard" else F.asc("distance"), F.asc("row_idx")]


def with_quota(rows: DataFrame, scores: DataFrame, budget: int, balance: float, n: int) -> DataFrame:
    """Add to rows each row's cluster quota: least(n_c, floor(balance * n_c * budget / n)), in doubles and in that order.

    Sizes are counted with partial sums and joined back, so a cluster is never gathered for it.
    """
    size = F.col("size")
    quota = F.least(size, F.floor(F.lit(float(balance)) * size * budget / float(max(n, 1))).cast("long"))
    sizes = scores.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("quota", quota)
    return rows.join(sizes.select("cluster", "quota"), "cluster")


def select_by_score(scores: DataFrame, budget: int, keep: str = "hard", balance: float = 0.5) -> DataFrame:
    """Rows (row_idx, cluster, distance, ...) with keep_rank, quota and selected: exactly `budget` rows are selected.

    A cluster's quota goes to its own best; what is left goes to the best of all others. The rank inside a cluster
    comes from the global rank, so both windows sort on one long. The scores are written once and counted there; all ranks
    read them from there.
    """
    scores = cut(scores)
    n = scores.count()
    check(n, budget, keep, balance)
    held = with_quota(ranked(scores, priority(keep), "keep_rank", n), scores, budget, balance, n)
    held = ranked_within(held, "cluster", "keep_rank", "__own", n).withColumn("__own", F.col("__own") <= F.col("quota"))
    filled = ranked(held, [F.desc("__own"), F.asc("keep_rank")], "__fill", n)
    return filled.withColumn("selected", F.col("__fill") <= budget).drop("__own", "__fill")


def select_by_scores(scores: DataFrame, run: str, budget: int, n: int, keep: str = "hard", balance: float = 0.5) -> DataFrame:
    """select_by_score() of several runs at once, of n rows each: rows (run, row_idx, cluster, distance) with selected and `rank`, the mean rank of distance in the run.

    Ranks come from one global sort by run, so a run is no one task.
    """
    check(n, budget, keep, balance)
    whole = scores.count()
    order = ranked(scores, [F.asc(run), *priority(keep)], "__place", whole).withColumn("keep_rank", F.col("__place") - F.col(run).cast("long") * n)
    sizes = scores.groupBy(run, "cluster").agg(F.count(F.lit(1)).alias("size"))
    quota = F.least("size", F.floor(F.lit(float(balance)) * F.col("size") * budget / float(max(n, 1))).cast("long"))
    # One row a run and cluster.
    held = cut(order.join(sizes.select(run, "cluster", quota.alias("quota")), [run, "cluster"]).withColumn("__group", F.struct(run, "cluster")))
    own = ranked_within(held, "__group", "__place", "__own", whole).withColumn("__own", F.col("__own") <= F.col("quota"))
    filled = ranked(own, [F.asc(run), F.desc("__own"), F.asc("keep_rank")], "__fill", whole).withColumn("selected", F.col("__fill") - F.col(run).cast("long") * n <= budget)
    # Ties share their mean rank; a hot distance is summed in each task first.
    last = held.groupBy(run, "distance").agg(F.avg("keep_rank").alias("__mean"))
    rank = F.col("__mean") if keep == "easy" else float(n + 1) - F.col("__mean")
    return filled.join(last, [run, "distance"]).select(run, "row_idx", "cluster", "distance", "selected", rank.alias("rank"))
