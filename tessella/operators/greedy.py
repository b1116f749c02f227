"""Prototype masses and greedy concave coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import submodular


def prototype_mass(patches: DataFrame, gamma: float) -> DataFrame:
    """(image_id, proto_id, mass) of (image_id, proto_id, distance): sums of (distance / mean distance) ** gamma."""
    if gamma < 0:
        raise ValueError(f"gamma must be >= 0, got {gamma}")
    if gamma == 0:
        return patches.groupBy("image_id", "proto_id").agg(F.count(F.lit(1)).cast("double").alias("mass"))
    mean = patches.agg(F.avg("distance").alias("mean"))
    weight = F.pow(F.col("distance") / F.col("mean"), F.lit(float(gamma)))
    return patches.crossJoin(F.broadcast(mean)).groupBy("image_id", "proto_id").agg(F.sum(weight).alias("mass"))


def balance_summary(mass: DataFrame, chosen: DataFrame) -> DataFrame:
    """(part, entropy, covered) of the pool and of the subset chosen (image_id): entropy of the prototypes' masses, natural log, and prototypes with mass."""
    own = mass.join(chosen.select("image_id").distinct(), "image_id", "left_semi").select("proto_id", "mass", F.lit("subset").alias("part"))
    sums = mass.select("proto_id", "mass", F.lit("pool").alias("part")).unionByName(own).groupBy("part", "proto_id").agg(F.sum("mass").alias("m"))
    p = F.col("m") / F.sum("m").over(W.partitionBy("part"))
    return sums.select("part", "m", p.alias("p")).where("m > 0").groupBy("part").agg(F.round(-F.sum(F.col("p") * F.ln("p")), 6).alias("entropy"), F.count(F.lit(1)).alias("covered"))


def packed(mass: DataFrame, order: DataFrame) -> DataFrame:
    """(row_idx, protos, masses) of each row of order (image_id, row_idx)."""
    lists = mass.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("proto_id", "mass"))).alias("m"))
    return order.join(lists, "image_id", "left").select("row_idx", F.coalesce(F.transform("m", lambda e: e["proto_id"].cast("int")), F.array().cast("array<int>")).alias("protos"), F.coalesce(F.transform("m", lambda e: e["mass"]), F.array().cast("array<double>")).alias("masses"))


def greedy(rows: DataFrame, budget: int, alpha: float, k: int, top: int = submodular.FETCH) -> list[int]:
    """row_idx in pick order, maximising the summed covered mass to the power alpha; the first row on ties."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    return [i for i, _ in submodular.exact(rows.withColumn("bonus", F.lit(0.0)), budget, submodular.Power(alpha), k, top)]
