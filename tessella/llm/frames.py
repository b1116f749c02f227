"""Frame helpers of the corpus operators: lineage cuts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few longs each, some 40 bytes.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder that driver and executors share."""
    context = spark.sparkContext
    ready(spark)
    return f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder and cut its lineage.

    The folder is the cluster's spark.checkpoint.dir; a folder of our own is set only where that is unset, as in tests.
    """
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a frame as a table in the shared checkpoint folder and read it back: smaller than a checkpoint, and pruned by column."""
    path = shared_folder(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is executed inside: JVM and Python each hold some of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of (a long, b long) edges: (id, component), the component being its smallest id.

    Alternating large-star and small-star steps. A node's neighbours are reduced to their minimum before the shuffle; the minima
    come back to the edges by broadcast if the edges were counted to half of BROADCAST_ROWS; else they are written and joined by two
    plain shuffles, whose hubs adaptive execution splits. Self-loops and repeats are allowed. The number of steps grows with the logarithm of the diameter.
    Ends when a step changes nothing.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = cut(links)
    state = None
    for _ in range(limit):
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        few = 2 * now[0] <= BROADCAST_ROWS
        minima, kept = (F.broadcast, lambda df: df) if few else (cut, cut)
        both = links.union(links.select("v", "u"))
        least = minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = minima(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components: no fixpoint after {limit} steps")
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a frame of a few longs a row for broadcast if it was counted to at most `rows` rows, some 20 MB; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def free(df: DataFrame, name: str) -> str:
    """A column name that a frame does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
