"""Lineage cuts and global ranks that hold at any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ONE_TASK = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder; one of our own is set only where none is."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the session's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, order: list[Column], name: str, n: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Add the 1-based global rank of each row; n is the number of rows, where the caller has counted them.

    Up to `one_task` rows, one window ranks them. Beyond that rows are range-partitioned and sorted, each takes its place in
    its partition, and the counts of the partitions before it are added; only one count a partition is gathered.
    """
    if (df.count() if n is None else n) <= one_task:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__ranked_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__ranked_part", F.shiftright("__ranked_at", 33))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("__ranked_part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__ranked_part long, __ranked_before long")
    return placed.join(F.broadcast(offsets), "__ranked_part").withColumn(name, F.col("__ranked_before") + F.col("__ranked_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__ranked_at", "__ranked_part", "__ranked_before")


def ranked_within(df: DataFrame, group: str, place: str, name: str, n: int, one_task: int = ONE_TASK) -> DataFrame:
    """Add the 1-based rank by `place`, a global rank of 1 to n, among the rows of a group.

    Rows are ranked inside blocks of `one_task` places and the counts of the blocks before are added, so a hot group is no one task.
    """
    block = F.floor((F.col(place) - 1) / one_task)
    if n <= one_task:
        return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(place)).cast("long"))
    held = df.withColumn("__block", block)
    counts = held.groupBy(F.col(group).alias("__group"), "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__group").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__group", F.col("__block").alias("__at"), before.alias("__before"))
    own = F.row_number().over(W.partitionBy(group, "__block").orderBy(place))
    joined = held.withColumn("__own", own).join(offsets, (F.col(group) == F.col("__group")) & (F.col("__block") == F.col("__at")))
    return joined.withColumn(name, F.col("__before") + F.col("__own")).select(*df.columns, name)
