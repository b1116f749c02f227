"""Rarity-weighted coverage of patch concepts: the weighted chance that each concept is met in the subset.

F(S) = sum over concepts k of w_k (1 - product over rows i of S of (1 - p_ik)), w_k = freq_k ** -rarity. p_ik = 1 - exp(-n_ik / saturation), or the
share of i's patches at k without a saturation. In logs the product is a sum of masses -ln(1 - p_ik).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import submodular
from tessella.operators.greedy import packed

#: The mass of a concept that fills a row: 1 - exp(-40) is 1 in doubles.
FULL = 40.0


def counts(patches: DataFrame) -> DataFrame:
    """(image_id, proto_id, n) of patches (image_id, proto_id); rows with a null are left out."""
    return patches.where(F.col("image_id").isNotNull() & F.col("proto_id").isNotNull()).groupBy("image_id", "proto_id").agg(F.count(F.lit(1)).alias("n"))


def masses(counted: DataFrame, saturation: float | None) -> DataFrame:
    """(image_id, proto_id, mass): minus the log of the chance that a row misses a concept."""
    if saturation is not None:
        if saturation <= 0:
            raise ValueError(f"saturation must be above 0, got {saturation}")
        return counted.select("image_id", "proto_id", F.least(F.col("n") / float(saturation), F.lit(FULL)).alias("mass"))
    whole = counted.groupBy("image_id").agg(F.sum("n").alias("whole"))
    share = F.col("n") / F.col("whole")
    return counted.join(whole, "image_id").select("image_id", "proto_id", F.when(share >= 1, FULL).otherwise(F.least(-F.log1p(-share), F.lit(FULL))).alias("mass"))


def weights(counted: DataFrame, rarity: float) -> DataFrame:
    """(proto_id, weight): each concept's share of all patches to the power -rarity. One row a concept."""
    per = counted.groupBy("proto_id").agg(F.sum("n").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("whole")))).select("proto_id", F.pow(F.col("n") / F.col("whole"), F.lit(-float(rarity))).alias("weight"))


def value(mass: DataFrame, weight: DataFrame, chosen: DataFrame) -> DataFrame:
    """(value, whole, met): the objective of the rows chosen (image_id), the same of all rows, and the concepts with a mass in the subset."""
    own = chosen.select("image_id").distinct().withColumn("__in", F.lit(1))
    sums = mass.join(own, "image_id", "left").groupBy("proto_id").agg(F.sum("mass").alias("all"), F.coalesce(F.sum(F.when(F.col("__in") == 1, F.col("mass"))), F.lit(0.0)).alias("own"))
    part = lambda c: F.sum(F.col("weight") * (1.0 - F.exp(-F.col(c))))
    # One row a concept.
    return sums.join(F.broadcast(weight), "proto_id").agg(F.round(part("own"), 6).alias("value"), F.round(part("all"), 6).alias("whole"), F.count_if(F.col("own") > 0).alias("met"))


def choose(patches: DataFrame, items: DataFrame, budget: int, *, saturation: float | None = None, rarity: float = 1.0, eps: float | None = 0.1, bonus: DataFrame | None = None, strength: float = 0.0) -> DataFrame:
    """(row_idx, keep_rank, gain) of items (image_id, row_idx): threshold passes within eps, or plain greedy with eps=None.

    bonus (image_id, value), times strength, is added to a row's gain. Items without patches gain their bonus alone; patches of no
    item count in the concepts' shares and are never picked. On the driver are the concepts' weights.
    """
    counted = counts(patches).persist()
    table = {r.proto_id: r.weight for r in weights(counted, rarity).collect()}
    k = max(table, default=0) + 1
    w = np.array([table.get(i, 0.0) for i in range(k)])
    rows = packed(masses(counted, saturation), items)
    if bonus is not None and strength:
        own = items.select("image_id", "row_idx").join(bonus.select("image_id", "value"), "image_id").select("row_idx", (F.col("value") * float(strength)).alias("bonus"))
        rows = rows.join(own, "row_idx", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    else:
        rows = rows.withColumn("bonus", F.lit(0.0))
    objective = submodular.Survival(w)
    if eps is None:
        order = submodular.exact(rows, budget, objective, k)
        out = rows.sparkSession.createDataFrame([(int(i), n + 1, g) for n, (i, g) in enumerate(order)], "row_idx long, keep_rank long, gain double")
    else:
        out, _ = submodular.threshold(rows, budget, objective, k, eps)
    counted.unpersist()
    return out
