"""Segmentation metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.vectors import PLACES


def confusion(pixels: DataFrame, ignore: int = 255) -> DataFrame:
    """(target, pred, n) of all pixels that are not ignored; parts of a table can be counted apart and summed."""
    return pixels.where(F.col("target") != ignore).groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_iou(matrix: DataFrame, classes: int) -> DataFrame:
    """(class_id, iou): hits over hits and misses of both kinds; null for a class that is nowhere."""
    hit = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    sides = matrix.select(F.explode(F.array(F.struct(F.col("target").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("h")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    own = sides.groupBy(F.col("c").cast("int").alias("class_id")).agg(F.sum("h").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    ids = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("class_id"))
    return ids.join(own, "class_id", "left").select("class_id", F.round(F.try_divide(F.col("tp").cast("double"), F.col("t") + F.col("p") - F.col("tp")), PLACES).alias("iou"))


def summary(matrix: DataFrame, classes: int, rare: list[int]) -> DataFrame:
    """One row: miou and rare_miou over classes that are there, pixel_acc (0 without pixels)."""
    iou = class_iou(matrix, classes)
    means = iou.agg(F.round(F.avg("iou"), 6).alias("miou"), F.round(F.avg(F.when(F.col("class_id").isin(rare), F.col("iou"))), 6).alias("rare_miou"))
    right = F.coalesce(F.sum(F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)), F.lit(0)).cast("double")
    total = F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0)))
    return means.crossJoin(F.broadcast(matrix.agg(F.round(right / total, 6).alias("pixel_acc"))))


def rare_classes(counts: DataFrame, k: int) -> DataFrame:
    """The k classes of the fewest pixels, of (class_id, n), by (n, class_id): with their share of all pixels."""
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    at = F.row_number().over(W.orderBy("n", "class_id"))
    return counts.select("class_id", F.col("n").alias("pixel_count"), F.round(share, PLACES).alias("pixel_freq"), at.cast("int").alias("rank")).where(F.col("rank") <= k)


def boundary_f(pixels: DataFrame, ignore: int = 255, tolerance: int = 3) -> DataFrame:
    """(image_id, boundary_f) of (image_id, y, x, target, pred): mean over an image's classes of the harmonic mean of boundary precision and recall.

    Every image has a row; the score of one without a scorable class is null. A class's boundary are its pixels with one of their eight neighbours of another class or off the image. Boundary pixels on
    or next to an ignored pixel do not count. A pixel is matched by one of the other side's within `tolerance`. A class
    without a target boundary is skipped, one without a predicted boundary scores 0.
    """
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    spread = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in around])).alias("o")
    seen = pixels.select("image_id", "y", "x", "target", "pred", spread)
    near = pixels.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("target").alias("nt"), F.col("pred").alias("np"))
    met = seen.select("image_id", "y", "x", "target", "pred", (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx")).join(near, ["image_id", "ny", "nx"], "left")
    edge = lambda own, other: F.max(F.when(F.col(other).isNull() | (F.col(other) != F.col(own)), 1).otherwise(0)) == 1
    marked = met.groupBy("image_id", "y", "x", "target", "pred").agg(edge("target", "nt").alias("te"), edge("pred", "np").alias("pe"), (F.max(F.when(F.col("nt") == ignore, 1).otherwise(0)) == 1).alias("void"))
    marked = marked.where((F.col("target") != ignore) & ~F.col("void"))
    gt = marked.where("te").select("image_id", "y", "x", F.col("target").alias("c"))
    pr = marked.where("pe").select("image_id", "y", "x", F.col("pred").alias("c"))
    disk = [(dy, dx) for dy in range(-tolerance, tolerance + 1) for dx in range(-tolerance, tolerance + 1) if dy * dy + dx * dx <= tolerance * tolerance]
    shift = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk])).alias("o")

    def matched(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        wide = b.select("image_id", "y", "x", "c", shift).select("image_id", "c", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct().withColumn("hit", F.lit(1))
        return a.join(wide, ["image_id", "c", "y", "x"], "left").groupBy("image_id", "c").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias(name))

    classes = pixels.where(F.col("target") != ignore).select("image_id", F.col("target").alias("c")).distinct()
    both = classes.join(matched(gt, pr, "recall"), ["image_id", "c"]).join(matched(pr, gt, "precision"), ["image_id", "c"], "left")
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    scores = both.groupBy("image_id").agg(F.round(F.avg(f), PLACES).alias("boundary_f"))
    return pixels.select("image_id").distinct().join(scores, "image_id", "left")


def boundary_mean(scores: DataFrame) -> DataFrame:
    """One row, `boundary_f`: the mean over images that have a score; null if none has."""
    return scores.agg(F.round(F.avg(F.nanvl("boundary_f", F.lit(None).cast("double"))), 6).alias("boundary_f"))


def class_counts(pixels: DataFrame, classes: int) -> DataFrame:
    """(class_id, n) of the valid pixels of (target): those in [0, classes), so ignored ones do not count; absent classes hold 0."""
    valid = pixels.where((F.col("target") >= 0) & (F.col("target") < classes))
    ids = pixels.sparkSession.range(classes).select(F.col("id").cast("int").alias("class_id"))
    own = valid.groupBy(F.col("target").cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(own, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("n"))
