"""Zero-shot coverage scores: random points of random subspaces vote for their nearest rows, and rows near a voted one lose.

A row's score is a seeded tie-breaker in [0, 1), plus one for each draw that it is nearest to, minus its share of each vote of
another row: a vote is dealt to the row's `neighbours` nearest others, in shares that fall with their distance. Draws and tie-breakers come from seeds and ids, so partitions do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.kcenter import distance, matrix
from tessella.plans.lineage import cut, ranked

DRAWS = 10_000
SUBSPACE = 2
NEIGHBOURS = 10
FALL = 4.0
#: Draws, or voted rows, that a task compares with a batch of rows at once.
TOGETHER = 512
PLACES = 9


def chance(seed: int, key: Column) -> Column:
    """A tie-breaker in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def ranges(rows: DataFrame) -> np.ndarray:
    """[3, d]: least, mean and largest value of each dimension, the mean rounded so that partial sums do not change draws."""
    each = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.round(F.avg("x"), PLACES).alias("mean"), F.max("x").alias("hi"))
    return np.array([(r.lo, min(max(r.mean, r.lo), r.hi), r.hi) for r in sorted(each.collect())]).T


def points(limits: np.ndarray, draws: int, subspace: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions [draws, subspace], places): of each draw, distinct dimensions and a triangular place in each, with its mode at the mean."""
    rng = np.random.default_rng(seed)
    lo, mode, hi = limits
    dims = np.argsort(rng.random((draws, len(lo))), axis=1)[:, :subspace]
    u = rng.random(dims.shape)
    a, c, b = lo[dims], mode[dims], hi[dims]
    width = np.maximum(b - a, 1e-300)
    left = u * width < c - a
    return dims, np.where(left, a + np.sqrt(u * width * np.maximum(c - a, 0.0)), b - np.sqrt((1.0 - u) * width * np.maximum(b - c, 0.0)))


def votes(rows: DataFrame, dims: np.ndarray, places: np.ndarray) -> DataFrame:
    """(row_idx, votes): how many draws each row is nearest to in the draw's subspace, the first row on ties. A task returns one row a draw."""
    shared = rows.sparkSession.sparkContext.broadcast((dims, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, places = shared.value
        best, at = np.full(len(dims), np.inf), np.full(len(dims), np.iinfo(np.int64).max)
        for batch in batches:
            ids, x = np.asarray(batch.column(0)), matrix(batch)
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            for lo in range(0, len(dims) if len(ids) else 0, TOGETHER):
                own = slice(lo, lo + TOGETHER)
                away = sum(np.abs(x[:, dims[own, j]] - places[own, j]) for j in range(dims.shape[1]))
                away = np.round(away, PLACES)
                j = away.argmin(axis=0)
                value = away[j, np.arange(away.shape[1])]
                better = (value < best[own]) | ((value == best[own]) & (ids[j] < at[own]))
                best[own], at[own] = np.where(better, value, best[own]), np.where(better, ids[j], at[own])
        held = np.flatnonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(best[held]), pa.array(at[held])], ["draw", "away", "row_idx"])

    nearest = rows.select("row_idx", "v").mapInArrow(run, "draw long, away double, row_idx long").groupBy("draw").agg(F.min(F.struct("away", "row_idx")).alias("m"))
    return nearest.groupBy(F.col("m.row_idx").alias("row_idx")).agg(F.count(F.lit(1)).alias("votes"))


def least(away: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, value) of the `most` least finite values of each line, ties by ids: only those up to a line's last one are sorted."""
    edge = np.partition(away, most - 1, axis=1)[:, most - 1, None] if 0 < most < away.shape[1] else np.inf
    i, j = np.nonzero((away <= edge) & np.isfinite(away))
    value = away[i, j]
    order = np.lexsort((ids[j], value, i))
    i, j, value = i[order], j[order], value[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[kept], j[kept], value[kept]


def redundancy(rows: DataFrame, voted: DataFrame, neighbours: int, fall: float) -> DataFrame:
    """(row_idx, lost): over the voted rows (row_idx, v, votes), votes times each nearest other's share, in proportion to (nearest distance / distance) ** fall.

    The voted rows, at most one a draw, are sent to all tasks; a task returns its `neighbours` nearest rows of each.
    """
    held = sorted(voted.select("row_idx", "v", "votes").collect())
    if not held:
        return rows.sparkSession.createDataFrame([], "row_idx long, lost double")
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r.row_idx for r in held]), np.array([r.v for r in held])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, centre = shared.value
        for batch in batches:
            ids, x = np.asarray(batch.column(0)), matrix(batch)
            for lo in range(0, len(own) if len(ids) else 0, TOGETHER):
                away = distance(centre[lo : lo + TOGETHER], x)
                away[own[lo : lo + TOGETHER, None] == ids[None, :]] = np.inf
                i, j, value = least(away, ids, neighbours)
                yield pa.RecordBatch.from_arrays([pa.array(own[lo + i]), pa.array(ids[j]), pa.array(value)], ["centre", "row_idx", "away"])

    near = rows.select("row_idx", "v").mapInArrow(run, "centre long, row_idx long, away double")
    place = F.row_number().over(W.partitionBy("centre").orderBy("away", "row_idx"))
    nearest = F.min("away").over(W.partitionBy("centre"))
    kept = near.withColumn("place", place).where(F.col("place") <= neighbours).withColumn("nearest", nearest)
    fallen = F.when(F.col("away") <= F.col("nearest"), 1.0).otherwise(F.pow(F.col("nearest") / F.col("away"), F.lit(float(fall))))
    kept = kept.withColumn("fallen", fallen)
    share = F.col("fallen") / F.sum("fallen").over(W.partitionBy("centre"))
    kept = kept.select("centre", "row_idx", share.alias("share"))
    counts = rows.sparkSession.createDataFrame([(int(r.row_idx), int(r.votes)) for r in held], "centre long, votes long")
    return kept.join(F.broadcast(counts), "centre").groupBy("row_idx").agg(F.sum(F.round(F.col("share") * F.col("votes"), PLACES)).alias("lost"))


def scores(rows: DataFrame, *, draws: int = DRAWS, subspace: int = SUBSPACE, neighbours: int = NEIGHBOURS, fall: float = FALL, seed: int = 0) -> DataFrame:
    """(image_id, row_idx, votes, lost, score) of every row (image_id, row_idx, v).

    Two passes over the rows, each against at most `draws` points, so work is draws times rows and nothing that grows with the rows is sent
    or collected. Subspaces wider than the vectors are whole vectors.
    """
    if draws < 0 or subspace < 1 or neighbours < 0:
        raise ValueError(f"draws={draws}, subspace={subspace} and neighbours={neighbours} must be no less than 0, 1 and 0")
    # Ranked rows lie in one partition; every draw is compared with all of them.
    rows = cut(rows.select("image_id", "row_idx", "v").repartition(rows.sparkSession.sparkContext.defaultParallelism, "row_idx"))
    limits = ranges(rows)
    if limits.size == 0:
        return rows.select("image_id", "row_idx", F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("lost"), F.lit(0.0).alias("score"))
    found = cut(votes(rows, *points(limits, draws, min(subspace, limits.shape[1]), seed)))
    lost = redundancy(rows, rows.join(F.broadcast(found), "row_idx"), neighbours, fall)
    out = rows.select("image_id", "row_idx").join(F.broadcast(found), "row_idx", "left").join(lost, "row_idx", "left")
    out = out.select("image_id", "row_idx", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("lost", F.lit(0.0)).alias("lost"))
    return out.withColumn("score", F.round(chance(seed, F.col("image_id")) + F.col("votes") - F.col("lost"), 6))


def choose(rows: DataFrame, budget: int, seed: int = 0, **options) -> DataFrame:
    """scores() with keep_rank, by score and then row_idx, and selected."""
    found = cut(scores(rows, seed=seed, **options))
    n = found.count()
    if budget < 0 or budget > n:
        raise ValueError(f"budget={budget} is out of range")
    return ranked(found, [F.desc("score"), F.asc("row_idx")], "keep_rank", n).withColumn("selected", F.col("keep_rank") <= budget)
