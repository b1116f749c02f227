"""Subset files, rare-class files, exported runs and the append-only ledger."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = {
    **dict.fromkeys(("run_id", "git_commit", "config_hash", "wandb_run_id", "wandb_url", "timestamp", "dataset", "model", "selection_method", "representation"), "string"),
    "ratio": "double", "seed": "int", "n_images": "int", "epochs": "int", "iterations": "int", "lr": "double", "lr_schedule": "string",
    **dict.fromkeys(("miou", "rare_class_miou", "pixel_acc", "boundary_f"), "double"), "per_class_iou_json": "string",
    **dict.fromkeys(("retention_vs_full_matched", "gpu_hours_train", "selection_seconds"), "double"), "notes": "string",
}
SUBSET = "image_ids array<string>, dataset string, method string, name string, ratio double, seed int, n_images int, n_total int, selection_cfg string, selection_seconds double, pattern_extraction_seconds double"


def ledger_rows(rows: DataFrame) -> DataFrame:
    """Rows in the ledger's columns: unknown ones go, missing ones are null, a map of class IoUs becomes JSON, the time defaults to now."""
    kinds = dict(rows.dtypes)

    def column(name: str, kind: str):
        if name not in kinds:
            return F.lit(None)
        return F.to_json(name) if name == "per_class_iou_json" and kinds[name] != "string" else F.col(name)

    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return rows.select(*[(F.coalesce(column(n, k).cast(k), now) if n == "timestamp" else column(n, k).cast(k)).alias(n) for n, k in LEDGER.items()])


def append(rows: DataFrame, path: str) -> None:
    """Append to the ledger; `line` keeps the order of rows across appends, for the last row of a key to win."""
    spark = rows.sparkSession
    before = spark.read.parquet(path).agg(F.max("line")).first()[0] if exists(spark, path) else None
    placed = ledger_rows(rows).withColumn("line", F.monotonically_increasing_id() + F.lit(0 if before is None else before + 1))
    placed.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ledger kept as CSV, with `line`, the place of a row in the file; blank cells are null.

    Places come from the file's offsets, so they hold for one file, as append-only ledgers are.
    """
    rows = spark.read.schema(", ".join(f"{n} {k}" for n, k in LEDGER.items())).csv(path, header=True, nullValue="", escape='"')
    return rows.withColumn("line", F.monotonically_increasing_id())


def subsets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, method, ratio, seed, n_images, position, image_id) of subset files, each file once."""
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value").dropDuplicates(["file"])
    rows = text.select("file", F.from_json("value", SUBSET).alias("s")).select("file", F.coalesce("s.name", "s.method").alias("name"), "s.method", "s.ratio", "s.seed", "s.n_images", F.posexplode("s.image_ids").alias("position", "image_id"))
    return rows


def subset_text(ids: list[str], meta: dict) -> str:
    return json.dumps({"image_ids": sorted(ids), **meta}, indent=2)


def same_ids(old: DataFrame, new: DataFrame) -> bool:
    """Whether two subsets hold the same ids."""
    a, b = old.select("image_id"), new.select("image_id")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def save_subset(spark: SparkSession, path: str, ids: DataFrame, meta: dict, force: bool = False) -> bool:
    """Write a subset as one JSON row; an equal one stays, another one is refused unless forced. True when written."""
    if exists(spark, path):
        old = spark.read.json(path).select(F.explode("image_ids").alias("image_id"))
        if same_ids(old, ids):
            return False
        if not force:
            raise FileExistsError(f"{path} holds another subset")
    one = ids.agg(F.array_sort(F.collect_list(F.col("image_id").cast("string"))).alias("image_ids"))
    one.select("image_ids", *[F.lit(json.dumps(v) if isinstance(v, dict) else v).alias(k) for k, v in meta.items()]).coalesce(1).write.mode("overwrite").json(path)
    return True


def rare_ids(spark: SparkSession, path: str) -> DataFrame:
    """(rank, class_id) of a rare-class file."""
    schema = "dataset string, k int, rare_class_ids array<int>, rare_class_names array<string>, pixel_counts array<long>, pixel_freq array<double>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select(F.posexplode("r.rare_class_ids").alias("rank", "class_id"))


def exported_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a tracking service's JSON export, flattened to what reports use; states and missing metrics stay for the report to skip."""
    schema = """id string, name string, url string, created_at string, state string,
      config struct<dataset: struct<name: string>, model: struct<name: string>, selection_method: string, ratio: double, recipe: struct<name: string, seed_train: int, lr: double, epochs: int>>,
      summary map<string,double>"""
    runs = spark.read.schema(schema).json(path, multiLine=True)
    s = lambda key: F.try_element_at("summary", F.lit(key))
    return runs.select(
        "id", "name", "url", "created_at", "state", F.coalesce("config.dataset.name", F.lit("?")).alias("dataset"), F.coalesce("config.model.name", F.lit("?")).alias("model"),
        F.coalesce("config.selection_method", F.lit("?")).alias("method"), "config.ratio", F.col("config.recipe.seed_train").alias("seed"), "config.recipe.lr", "config.recipe.epochs",
        F.coalesce("config.recipe.name", F.lit("?")).alias("recipe"), s("_step").cast("int").alias("steps"), s("final/miou").alias("miou"), s("final/rare_class_miou").alias("rare_miou"),
        s("final/pixel_acc").alias("pixel_acc"), s("final/boundary_f").alias("boundary_f"), (s("_runtime") / 3600).alias("runtime_h"),
    )
