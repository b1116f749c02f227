"""Item scores: patch tails, average-rank percentiles and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.vectors import rounded, unit
from tessella.plans.lineage import ONE_TASK, cut, ranked

FUSIONS = ("meanrank", "minrank")


def tail_mean(distances: Column | str, q: float) -> Column:
    """Mean of the ceil(q * n) largest values of an array."""
    if not 0.0 < q <= 1.0:
        raise ValueError(f"q={q} is no share above 0 and up to 1")
    m = F.ceil(F.lit(float(q)) * F.size(distances)).cast("int")
    return rounded(F.aggregate(F.slice(F.sort_array(distances, False), F.lit(1), m), F.lit(0.0), lambda s, x: s + x) / m)


def tail_feature(patches: DataFrame, tail_percent: float) -> DataFrame:
    """(image_id, v): the unit mean of each image's farthest patches of (image_id, patch_idx, feature, distance); ties by patch_idx."""
    n = F.count(F.lit(1)).over(W.partitionBy("image_id"))
    at = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("distance"), "patch_idx"))
    kept = patches.withColumn("m", F.ceil(F.lit(float(tail_percent)) * n / 100)).withColumn("at", at).where("at <= m")
    return mean_feature(kept)


def mean_feature(patches: DataFrame) -> DataFrame:
    """(image_id, v): the unit vector of the mean of an image's patch vectors."""
    each = patches.select("image_id", F.posexplode("feature").alias("d", "x"))
    means = each.groupBy("image_id", "d").agg(F.avg("x").alias("x"))
    lists = means.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s"))
    return lists.select("image_id", unit(F.transform("s", lambda e: e["x"])).alias("v"))


def percentile(rows: DataFrame, score: str, name: str, n: int | None = None) -> DataFrame:
    """Add the ascending rank of score over n, in (0, 1]; equal scores share their mean rank. n is the number of rows, if counted before."""
    n = rows.count() if n is None else n
    if n <= ONE_TASK:
        ties = F.count(F.lit(1)).over(W.partitionBy(score))
        return rows.withColumn(name, (F.rank().over(W.orderBy(F.asc(score))) + (ties - 1) / 2.0) / float(max(n, 1)))
    placed = ranked(rows, [F.asc(score)], "__rank", n)
    mean = placed.groupBy(score).agg(F.avg("__rank").alias("__mean"))
    return placed.join(mean, score).withColumn(name, F.col("__mean") / float(max(n, 1))).drop("__rank", "__mean")


def fuse(rows: DataFrame, views: list[str], fusion: str = "meanrank") -> DataFrame:
    """Add `fused`: the mean or the least of the views' percentiles."""
    if fusion not in FUSIONS:
        raise ValueError(f"fusion must be one of {FUSIONS}, got {fusion!r}")
    rows = cut(rows)
    n = rows.count()
    out = reduce(lambda df, v: percentile(df, v, f"p_{v}", n), views, rows)
    columns = [F.col(f"p_{v}") for v in views]
    value = reduce(lambda a, b: a + b, columns) / len(columns) if fusion == "meanrank" else (F.least(*columns) if len(columns) > 1 else columns[0])
    return out.withColumn("fused", rounded(value))


def running_sum(rows: DataFrame, value: str, place: str, name: str, block: int = ONE_TASK) -> DataFrame:
    """Add the sum of value over the rows up to a row by `place`, a row number: sums inside blocks of places, and those of the blocks before."""
    held = rows.withColumn("__block", F.floor(F.col(place) / block))
    own = F.sum(value).over(W.partitionBy("__block").orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.sum("__sum").over(W.orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    offsets = held.groupBy(F.col("__block").alias("__at")).agg(F.sum(value).alias("__sum")).select("__at", before.alias("__before"))
    joined = held.withColumn("__own", own).join(offsets, F.col("__block") == F.col("__at"))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))
