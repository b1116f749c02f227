"""Incremental runs: derivations, features of new files, the run ledger and report rows. Each micro-batch has one effect, however often it is run.

A batch's rows go to a partition of its own, named by the checkpoint and the batch's number, which a further run of the batch overwrites.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import report
from tessella.sources import ledger, store


def upsert_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert derivations as files arrive. A batch that is run again replaces its own rows, so its effect is the same."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch.sparkSession, path, batch.dropDuplicates(list(store.KEY)))

    return started(rows, write, checkpoint)


def started(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_name(checkpoint: str, number: int) -> str:
    return f"{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}-{number:09d}"


def written_once(rows: DataFrame, path: str, name: str) -> None:
    """Write rows as the partition batch=name of a table, in place of what an earlier run of the batch left there."""
    rows.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def ledger_batch(rows: DataFrame, path: str, checkpoint: str, number: int) -> None:
    """Append a batch of runs to a streamed ledger. `line` grows with the batches of one checkpoint and needs no look at the table, so writers do not collide."""
    placed = ledger.ledger_rows(rows).withColumn("line", F.lit(number).cast("long") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40))
    written_once(placed, path, batch_name(checkpoint, number))


def ledger_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append runs to a ledger of its own as they arrive, exactly once: a batch that is run again overwrites its rows, those without a key too."""
    return started(rows, lambda batch, number: ledger_batch(batch, path, checkpoint, number), checkpoint)


def report_batch(rows: DataFrame, runs_path: str, out: str, checkpoint: str, number: int) -> None:
    """Add a batch's finished runs to the table of all, and its families' rows over all runs so far to `out`, as the report's next state of them."""
    spark, name = rows.sparkSession, batch_name(checkpoint, number)
    done = report.finished(rows).where("skip_reason IS NULL").drop("skip_reason")
    written_once(done, runs_path, name)
    # Partitions of later batches do not count, so a batch that is run again gives what it gave.
    every = spark.read.parquet(runs_path).where(F.col("batch") <= name)
    touched = every.where(F.col("batch") == name).select("family").distinct()
    last = every.drop("batch").dropDuplicates(["id"])
    table = report.families(last).join(report.retention(last), ["family", *report.KEY, "n_runs"], "left")
    written_once(table.join(touched, "family", "left_semi"), out, name)


def report_stream(rows: DataFrame, runs_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Runs (report columns with state, family and n_images) into a growing report: each batch adds the rows of the families that it touches."""
    return started(rows, lambda batch, number: report_batch(batch, runs_path, out, checkpoint, number), checkpoint)


def report_rows(spark: SparkSession, out: str) -> DataFrame:
    """The report's present rows: of each family, those of the last batch that touched it."""
    table = spark.read.parquet(out)
    return table.join(table.groupBy("family").agg(F.max("batch").alias("batch")), ["family", "batch"], "left_semi").drop("batch")


def extract_stream(spark: SparkSession, source: str, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Features of the files under a folder that no start has seen: extract() gets (path, length, content), and its rows go to the feature table.

    The file source's log in the checkpoint tells which files are new, in place of a scan of the ids that are there. A file is read once; a batch that failed is read again and overwrites its rows.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    return started(files, lambda batch, number: written_once(extract(batch), path, batch_name(checkpoint, number)), checkpoint)
