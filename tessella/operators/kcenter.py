"""k-centre selection by farthest points on the unit sphere, exact or from composable centres of blocks. Distances are Euclidean, so they are a metric."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import draw_key
from tessella.plans.lineage import cut

PLACES = 9
TOP = 1024
#: Rows of a task that are in memory together.
BLOCK = 8192
ROW = "row_idx long, v array<double>"


def matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit rows of a to unit rows of b, rounded, so that blocks do not change ties."""
    return np.round(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T))), PLACES)


def farthest(points: np.ndarray, gap: np.ndarray, most: int, least: float = 0.0) -> tuple[list[int], list[float]]:
    """Farthest-point picks of a block, the first on ties, while the gap is above `least`: places and gaps at the picks."""
    picked, gaps, gap = [], [], gap.copy()
    while len(picked) < min(most, len(points)):
        at = int(gap.argmax())
        if picked and gap[at] <= least:
            break
        picked.append(at)
        gaps.append(float(gap[at]))
        gap = np.minimum(gap, distance(points, points[at : at + 1])[:, 0])
    return picked, gaps


def composed(rows: DataFrame, budget: int, eps: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Of each block of at most `block` rows, farthest-point centres until all its rows are within eps / 2 of the gap left after `budget` picks.

    That gap is at most twice the best radius, by the pigeonhole on budget + 1 points that far apart. So every row is within eps best
    radii of a centre, and greedy over the centres is within 2 + eps of the best radius over all rows. One pass, no shuffle, a block in memory.
    """
    if eps <= 0:
        raise ValueError(f"eps must be above 0, got {eps}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                points = matrix(part)
                gap = np.full(len(points), np.inf)
                first, gaps = farthest(points, gap, budget + 1)
                left = gaps[budget] if len(gaps) > budget else 0.0
                held, _ = (first, gaps) if left == 0.0 else farthest(points, gap, len(points), eps / 2 * left)
                yield part.take(pa.array(sorted(held)))

    return rows.select("row_idx", "v").mapInArrow(run, ROW)


def centres(rows: DataFrame, budget: int, seed: int = 0, top: int = TOP) -> list[tuple[int, float | None]]:
    """(row_idx, gap) in pick order over (row_idx, image_id, v): the first row by the seeded draw, then the farthest from all picks, the first row on ties.

    A pass keeps each row's gap to the picks of all passes before, -1 for picks themselves, and returns the `top` rows of the largest; picks among them are those of
    plain greedy while their gap, which new picks only lower, is not below that of the rows that stayed. The gaps are a written column, so a pass
    costs its own picks alone. On the driver are `top` vectors and the picks' numbers.
    """
    n = rows.count()
    if budget < 0 or budget > n:
        raise ValueError(f"budget={budget} is out of range")
    if budget == 0:
        return []
    first = rows.orderBy(draw_key(seed, F.col("image_id")), "row_idx").select("row_idx", "v").first()
    order: list[tuple[int, float | None]] = [(first.row_idx, None)]
    fresh, new = [first.row_idx], np.asarray([first.v])
    held = rows.select("row_idx", "v", F.lit(float("inf")).alias("gap"))
    spark = rows.sparkSession
    while len(order) < budget:
        shared = spark.sparkContext.broadcast((np.asarray(fresh), new))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh, new = shared.value  # noqa: B023
            for batch in batches:
                if batch.num_rows:
                    gap = np.minimum(np.asarray(batch.column(2)), distance(matrix(batch), new).min(axis=1))
                    gap[np.isin(np.asarray(batch.column(0)), fresh)] = -1.0
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gap)], ["row_idx", "v", "gap"])

        held = cut(held.mapInArrow(run, ROW + ", gap double"))
        best = held.orderBy(F.desc("gap"), "row_idx").limit(top + 1).collect()
        bound = (-best[top].gap, best[top].row_idx) if len(best) > top else (np.inf, 0)
        ids, points, gap = np.array([r.row_idx for r in best[:top]]), np.array([r.v for r in best[:top]]), np.array([r.gap for r in best[:top]])
        fresh, new, live = [], [], gap >= 0
        while live.any() and len(order) < budget:
            at = min(np.flatnonzero(live & (gap == gap[live].max())), key=lambda i: ids[i])
            if new and bound < (-gap[at], ids[at]):
                break
            order.append((int(ids[at]), float(gap[at])))
            fresh.append(int(ids[at]))
            new.append(points[at])
            live[at] = False
            gap = np.minimum(gap, distance(points, points[at : at + 1])[:, 0])
        new = np.asarray(new)
    return order


def radius(rows: DataFrame, picked: DataFrame, block: int = 4096) -> float:
    """The largest distance of a row (v) to its nearest picked one, with the picks sent in blocks."""
    points = [np.asarray(r.v) for r in picked.select("v").toLocalIterator()]
    gap = rows.select("v", F.lit(float("inf")).alias("gap"))
    for lo in range(0, len(points), block):
        shared = rows.sparkSession.sparkContext.broadcast(np.stack(points[lo : lo + block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    gap = np.minimum(np.asarray(batch.column(1)), distance(matrix(batch), shared.value).min(axis=1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gap)], ["v", "gap"])

        gap = gap.mapInArrow(run, "v array<double>, gap double")
    return gap.agg(F.max("gap")).first()[0]


def choose(rows: DataFrame, budget: int, seed: int = 0, eps: float | None = None, top: int = TOP) -> DataFrame:
    """(row_idx, keep_rank, gap) of rows (image_id, row_idx, v): plain farthest-point greedy, within 2 of the best radius, or with eps over composable centres, within 2 + eps.

    gap is a pick's distance to the picks before it, null for the first. Equal rows come last. Rows with a null vector must be left out before.
    """
    pool = rows
    if eps is not None:
        pool = cut(rows.select("row_idx", "image_id").join(composed(rows, budget, eps), "row_idx"))
        if pool.count() < budget:
            pool = rows
    order = centres(pool, budget, seed, top)
    return rows.sparkSession.createDataFrame([(i, n + 1, g) for n, (i, g) in enumerate(order)], "row_idx long, keep_rank long, gap double")
