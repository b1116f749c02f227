"""Budgets over classes and regions: max-min fair shares, connected regions of patch grids, and a greedy choice under a budget of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.scalars import draw_key
from tessella.plans.lineage import cut, ranked, ranked_within

PLACES = 9


def fair_shares(sizes: DataFrame, budget: int) -> DataFrame:
    """(class_id, size, share) of sizes (class_id, size): as equal shares of the budget as the classes' sizes allow.

    Water-filling without a loop: with classes by size, the level after the first i are full is (budget - their sum) / those left; the first class
    that does not fit under its level stops the filling, and all from it on get that level. What the level's floor leaves goes one each to the
    first of them by class_id. Budgets of at least the sum of sizes give every row. One row a class, so one window takes all.
    """
    if budget < 0:
        raise ValueError(f"budget={budget} is out of range")
    order = W.partitionBy().orderBy("size", "class_id")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.count(F.lit(1)).over(W.partitionBy()) - F.row_number().over(order) + 1
    level = (F.lit(budget) - before) / left
    placed = sizes.select("class_id", "size", before.alias("before"), left.alias("left"), level.alias("level"))
    # Full as long as no smaller class has stopped the filling.
    stopped = F.max((F.col("size") > F.col("level")).cast("int")).over(W.partitionBy().orderBy("size", "class_id"))
    marked = placed.withColumn("stopped", stopped)
    stop = W.partitionBy("stopped")
    first = F.min(F.struct("before", "left")).over(stop)
    rest = F.lit(budget) - first["before"]
    many = F.max("left").over(stop)
    extra = (F.row_number().over(stop.orderBy("class_id")) <= F.pmod(rest, many)).cast("long")
    share = F.when(F.col("stopped") == 0, F.col("size")).otherwise(F.floor(rest / many) + extra)
    return marked.select("class_id", "size", share.cast("long").alias("share"))


def class_balanced(items: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Items (image_id, row_idx, class_id) with keep_rank in their class, its share, and selected: a seeded draw of each class's fair share.

    A null class is a class of its own. A hot class is ranked in blocks, so it is no one task.
    """
    held = cut(items.withColumn("__class", F.coalesce(F.concat(F.lit("c"), F.col("class_id").cast("string")), F.lit(""))).withColumn("__key", draw_key(seed, F.col("image_id"))))
    n = held.count()
    if budget > n:
        raise ValueError(f"budget={budget} is out of range")
    shares = fair_shares(held.groupBy(F.col("__class").alias("class_id")).agg(F.count(F.lit(1)).alias("size")), budget)
    placed = cut(ranked(held, [F.asc("__key"), F.asc("row_idx")], "__place", n))
    inside = ranked_within(placed, "__class", "__place", "keep_rank", n)
    # One row a class.
    joined = inside.join(F.broadcast(shares.select(F.col("class_id").alias("__class"), "share")), "__class")
    return joined.withColumn("selected", F.col("keep_rank") <= F.col("share")).drop("__class", "__key", "__place")


def labelled(grid: np.ndarray) -> np.ndarray:
    """The region of each cell of a label grid: the smallest flat place of the cells of one label that sides connect; -1 where the label is below 0."""
    h, w = grid.shape
    region = np.where(grid >= 0, np.arange(h * w).reshape(h, w), -1)
    while True:
        low = region.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            same = (grid[a] == grid[b]) & (grid[a] >= 0)
            least = np.where(same, np.minimum(low[a], low[b]), -1)
            low[a] = np.where(same, least, low[a])
            low[b] = np.where(same, np.minimum(low[b], least), low[b])
        # Follow each region to the region of its smallest place, so a path of n cells takes some log n turns.
        flat = low.ravel()
        low = np.where(flat >= 0, flat[np.maximum(flat, 0)], -1).reshape(h, w)
        if (low == region).all():
            return region
        region = low


def regions(patches: DataFrame, width: int) -> DataFrame:
    """(image_id, region, proto_id, pixels) of patches (image_id, patch_idx, proto_id): the connected parts of one concept in each image's grid of `width` columns.

    pixels counts patches; a region's id is its smallest patch_idx. Missing patches and null concepts belong to no region. A row is one image's grid; a
    batch's grids are labelled as one tall grid, an empty line after each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            at, label = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
            if len(at) == 0:
                continue
            height = np.maximum.reduceat(at, np.cumsum(sizes) - sizes) // width + 2
            start = (np.cumsum(height) - height) * width
            grid = np.full(int(height.sum()) * width, -1, dtype=np.int64)
            grid[np.repeat(start, sizes) + at] = label
            found = labelled(grid.reshape(-1, width)).ravel()
            ids, pixels = np.unique(found[found >= 0], return_counts=True)
            owner = np.searchsorted(start, ids, side="right") - 1
            columns = [batch.column(0).take(pa.array(owner)), pa.array((ids - start[owner]).astype(np.int32)), pa.array(grid[ids].astype(np.int32)), pa.array(pixels.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["image_id", "region", "proto_id", "pixels"])

    held = patches.where("image_id IS NOT NULL AND patch_idx >= 0 AND proto_id >= 0").select("image_id", F.struct(F.col("patch_idx").cast("long").alias("at"), F.col("proto_id").cast("long").alias("label")).alias("p"))
    kind = held.schema["image_id"].dataType.simpleString()
    grids = held.groupBy("image_id").agg(F.collect_list("p").alias("p")).select("image_id", F.col("p.at"), F.col("p.label"))
    return grids.mapInArrow(run, f"image_id {kind}, region int, proto_id int, pixels long")


def choose_regions(found: DataFrame, budget: int, *, rarity: float = 1.0, concave: float = 0.5) -> DataFrame:
    """Regions with worth a pixel, the pixels taken before, and selected: a cost-benefit greedy under a budget of pixels.

    The value of a subset is the sum over concepts of freq ** -rarity times its covered pixels to the power `concave`, so a region's gain a
    pixel falls as its concept is covered. Within a concept greedy takes small regions first, as they gain more a pixel; so a region's gain depends
    only on those before it in its concept, and the global order is that of gain a pixel, by running sums: one sort by concept and one by gain, no loop.
    The order stops at the first region that does not fit; no region with a worse gain is taken in its place.
    """
    if budget < 0 or rarity < 0 or not 0 < concave <= 1:
        raise ValueError(f"budget={budget}, rarity={rarity} and concave={concave} must be at least 0, at least 0 and in (0, 1]")
    held = cut(found)
    n = held.count()
    placed = cut(ranked(held, [F.asc("proto_id"), F.asc("pixels"), F.asc("image_id"), F.asc("region")], "__at", n))
    summed = running(placed, "proto_id", "__at", "pixels", "__own", n)
    freq = held.groupBy("proto_id").agg(F.sum("pixels").alias("p"))
    weight = freq.crossJoin(F.broadcast(freq.agg(F.sum("p").alias("all")))).select("proto_id", F.pow(F.col("p") / F.col("all"), F.lit(-float(rarity))).alias("w"))
    after, before = (F.pow(x.cast("double"), F.lit(float(concave))) for x in (F.col("__own"), F.col("__own") - F.col("pixels")))
    # One row a concept.
    worth = F.round(F.col("w") * (after - before) / F.col("pixels"), PLACES)
    judged = cut(summed.join(F.broadcast(weight), "proto_id").withColumn("worth", worth).drop("w", "__own", "__at"))
    order = cut(ranked(judged, [F.desc("worth"), F.asc("proto_id"), F.asc("pixels"), F.asc("image_id"), F.asc("region")], "keep_rank", n).withColumn("__all", F.lit(0)))
    taken = running(order, "__all", "keep_rank", "pixels", "taken", n)
    return taken.withColumn("selected", F.col("taken") <= budget).drop("__all")


def running(rows: DataFrame, group: str, place: str, value: str, name: str, n: int, block: int = 1_000_000) -> DataFrame:
    """Add the running sum of value by `place`, a global rank, within a group: sums inside blocks of places, and those of the blocks before."""
    held = rows.withColumn("__block", F.floor((F.col(place) - 1) / block))
    own = F.sum(value).over(W.partitionBy(group, "__block").orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.sum("__s").over(W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = held.groupBy(F.col(group).alias("__g"), F.col("__block").alias("__b")).agg(F.sum(value).alias("__s")).select("__g", "__b", before.alias("__before"))
    joined = held.withColumn("__in", own).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn(name, F.col("__before") + F.col("__in")).select(*rows.columns, name)
