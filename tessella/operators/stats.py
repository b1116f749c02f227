"""Comparisons of methods over runs: Wilcoxon's signed ranks with the exact null distribution, and the area under retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pairs up to which the null distribution is exact; beyond it the normal one with the correction for ties stands in.
EXACT = 200
PLACES = 9


def null_chances(ranks: Column | str) -> Column:
    """Chances of the rank sums 0, 1, 2 and so on when each of the (whole) ranks counts or not with chance one half: a convolution by each in turn."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    turn = lambda held, r: F.zip_with(F.concat(held, zeros(r)), F.concat(zeros(r), held), lambda a, b: (a + b) / 2)
    return F.aggregate(ranks, F.array(F.lit(1.0)), turn)


def signed_ranks(pairs: DataFrame, group: str = "method") -> DataFrame:
    """(group, n_pairs, n_used, w_plus, w_minus, p_value) of pairs (group, difference): the two-sided test that differences are symmetric about 0.

    Differences are rounded to 9 places, nulls are left out, zeros count in n_pairs alone, and equal sizes share their mean rank.
    Doubled ranks are whole, so the null distribution of their sum is exact with ties too, up to EXACT used pairs a group. A group without a used pair has a p of 1.
    """
    held = pairs.select(group, F.round("difference", PLACES).alias("x")).where("x IS NOT NULL")
    size = F.abs("x")
    ties = F.count(F.lit(1)).over(W.partitionBy(group, "size"))
    rank = F.rank().over(W.partitionBy(group).orderBy("size"))
    used = held.where("x <> 0").withColumn("size", size).select(group, "x", (2 * rank + ties - 1).alias("r2"), ties.alias("ties"))
    sums = used.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_used"), F.sum(F.when(F.col("x") > 0, F.col("r2")).otherwise(0)).alias("plus2"), F.sum(F.when(F.col("x") < 0, F.col("r2")).otherwise(0)).alias("minus2"),
        F.sum(F.col("r2") * F.col("r2")).alias("square"), F.when(F.count(F.lit(1)) <= EXACT, F.sort_array(F.collect_list("r2"))).alias("ranks"),
    )
    low = F.least("plus2", "minus2")
    tail = F.aggregate(F.slice("chances", F.lit(1), (low + 1).cast("int")), F.lit(0.0), lambda s, x: s + x)
    # A sum of doubled ranks that each count or not has the variance of a quarter of their squares; half the difference of both sums is its distance from the mean.
    z = (F.abs(F.col("plus2") - F.col("minus2")) / 2.0) / F.sqrt(F.col("square") / 4.0)
    p = F.when(F.col("ranks").isNotNull(), F.least(F.lit(1.0), 2 * tail)).otherwise(two_sided(z))
    tested = sums.withColumn("chances", null_chances("ranks")).select(group, "n_used", (F.col("plus2") / 2).alias("w_plus"), (F.col("minus2") / 2).alias("w_minus"), p.alias("p"))
    whole = held.groupBy(group).agg(F.count(F.lit(1)).alias("n_pairs")).join(tested, group, "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return whole.select(group, "n_pairs", zero("n_used", 0), zero("w_plus", 0.0), zero("w_minus", 0.0), F.round(F.coalesce("p", F.lit(1.0)), PLACES).alias("p_value"))


def two_sided(z: Column) -> Column:
    """The chance that a standard normal is further than z from 0, to some 7 places, by a rational approximation of erfc with relative error below 1.2e-7."""
    x = z / 2**0.5
    t = 1.0 / (1.0 + 0.5 * x)
    # The coefficients of that published approximation, from the constant on.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    series = F.lit(0.0)
    for c in reversed(coefficients):
        series = series * t + c
    return t * F.exp(-x * x + series)


def paired(runs: DataFrame, baseline: str = "random", metric: str = "miou", keys: tuple[str, ...] = ("ratio", "seed", "dataset", "model", "recipe", "lr", "epochs")) -> DataFrame:
    """(method, keys..., difference): each method's mean over runs of equal keys less the baseline's; keys without a baseline are left out."""
    means = runs.groupBy("method", *keys).agg(F.avg(metric).alias("m"))
    base = means.where(F.col("method") == baseline).select(*keys, F.col("m").alias("b"))
    return means.where(~F.col("method").isin(baseline, "full")).join(base, list(keys)).select("method", *keys, (F.col("m") - F.col("b")).alias("difference"))


def area(curves: DataFrame, group: str = "method", low: float | None = None, high: float | None = None) -> DataFrame:
    """(group, n_ratios, low, high, auc) of curves (group, ratio, value): the mean height between low and high by trapezoids.

    Ratios may be uneven and differ between groups; repeated ones are averaged, nulls left out. Without bounds the range is the one that all groups cover. An end between two of
    a group's ratios is read off the line between them; a group that does not reach an end has a null area, as has one ratio alone, or an empty range.
    """
    held = curves.where("ratio IS NOT NULL AND value IS NOT NULL").groupBy(group, "ratio").agg(F.avg("value").alias("value"))
    spans = held.groupBy(group).agg(F.min("ratio").alias("first"), F.max("ratio").alias("last"), F.count(F.lit(1)).alias("n_ratios"))
    # One row a group, and one row of bounds.
    bounds = spans.agg(F.coalesce(F.lit(low).cast("double"), F.max("first")).alias("low"), F.coalesce(F.lit(high).cast("double"), F.min("last")).alias("high"))
    order = W.partitionBy(group).orderBy("ratio")
    pieces = held.select(group, F.col("ratio").alias("x0"), F.col("value").alias("y0"), F.lead("ratio").over(order).alias("x1"), F.lead("value").over(order).alias("y1")).crossJoin(F.broadcast(bounds))
    a, b = F.greatest("x0", "low"), F.least("x1", "high")
    height = lambda x: F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0"))
    areas = pieces.where("x1 IS NOT NULL").select(group, F.when(b > a, (b - a) * (height(a) + height(b)) / 2).otherwise(0.0).alias("s")).groupBy(group).agg(F.sum("s").alias("s"))
    out = spans.crossJoin(F.broadcast(bounds)).join(areas, group, "left")
    covered = (F.col("first") <= F.col("low")) & (F.col("last") >= F.col("high")) & (F.col("high") > F.col("low"))
    return out.select(group, "n_ratios", "low", "high", F.when(covered, F.round(F.col("s") / (F.col("high") - F.col("low")), 6)).alias("auc"))
