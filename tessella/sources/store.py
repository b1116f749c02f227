"""Vector stores: derived embeddings with provenance, patch vectors, vocabularies and prototypes, all Parquet tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.naming import EmbeddingSpec, canonical
from tessella.functions.vectors import finite, unit
from tessella.plans.lineage import cut

KEY = ("image_id", "split", "backbone", "source", "method", "params")
PARTITIONS = ("dataset", "split", "backbone", "method")
DERIVED = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("image_id", "image_path", "dataset", "split", "backbone", "source", "method", "params")],
    T.StructField("dim", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False)),
    T.StructField("config_hash", T.StringType()), T.StructField("created_at", T.StringType()),
])


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at a path, with its fixed schema; empty where the path does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def derived(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, DERIVED)


def derivation(vectors: DataFrame, *, dataset: str, split: str, backbone: str, source: str, method: str, params: dict | None = None, config_hash: str = "") -> DataFrame:
    """Rows of one derivation in the table's schema, from (image_id, embedding) and image_path, if there."""
    path = F.col("image_path") if "image_path" in vectors.columns else F.lit("")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    given = {"image_id": F.col("image_id").cast("string"), "image_path": path, "dim": F.size("embedding"), "embedding": F.col("embedding").cast("array<float>"), "created_at": now}
    fixed = {"dataset": dataset, "split": split, "backbone": backbone, "source": source, "method": method, "params": canonical(params or {}), "config_hash": config_hash}
    return vectors.select(*[given[n].alias(n) if n in given else F.lit(fixed[n]).alias(n) for n in DERIVED.names])


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows without those of a new key, and the new rows."""
    return old.join(new.select(*KEY).distinct(), list(KEY), "left_anti").select(*DERIVED.names).unionByName(new.select(*DERIVED.names))


def upsert(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Replace or append a derivation. Only the partitions that it touches are read and written again.

    The rows are materialised before the write, since they come from the path that is written.
    """
    touched = new.select(*PARTITIONS).distinct()
    old = derived(spark, path).join(touched, list(PARTITIONS), "left_semi").select(*DERIVED.names)
    rows = cut(upserted(old, new))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def matching(table: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """Rows of a spec's derivation; the filter reaches the partitions and the scan. The source is not compared."""
    return table.where((F.col("split") == spec.split) & (F.col("backbone") == spec.backbone) & (F.col("method") == spec.method) & (F.col("params") == canonical(spec.params)))


def available(table: DataFrame) -> DataFrame:
    return table.select("split", "backbone", "method", "params").distinct()


def examples(rows: DataFrame, n: int = 3) -> tuple[int, list]:
    return rows.count(), [r[0] for r in rows.orderBy("image_id").select("image_id").limit(n).collect()]


def missing(ids: DataFrame, table: DataFrame) -> DataFrame:
    return ids.join(table.select("image_id"), "image_id", "left_anti")


def repeated(table: DataFrame) -> DataFrame:
    return table.groupBy("image_id").count().where("count > 1")


def aligned(ids: DataFrame, table: DataFrame, what: str = "embedding") -> DataFrame:
    """(image_id, row_idx, embedding) of all requested ids. A repeated, missing or non-finite one is an error, never a skip."""
    for rows, fault in ((repeated(table), "have several rows"), (missing(ids, table), f"have no {what}"), (table.where(~finite("embedding")), "hold a null or non-finite value")):
        n, some = examples(rows)
        if n:
            raise ValueError(f"{n} ids {fault}, such as {some}")
    return ids.join(table.select("image_id", "embedding"), "image_id")


def load(spark: SparkSession, path: str, ids: DataFrame, spec: EmbeddingSpec) -> DataFrame:
    """The vectors of a spec, by id; a spec that nothing matches is an error that names what there is."""
    table = matching(derived(spark, path), spec) if spec.source == "derived" else raw_vectors(spark, path, spec)
    if table.isEmpty():
        there = [tuple(r) for r in available(derived(spark, path)).limit(20).collect()] if spec.source == "derived" else []
        raise LookupError(f"nothing matches {spec.describe()}; there are {there}")
    return aligned(ids, table, spec.describe())


def raw_vectors(spark: SparkSession, path: str, spec: EmbeddingSpec) -> DataFrame:
    """(image_id, embedding) of one raw tensor; it must be flat."""
    table = spark.read.parquet(path)
    kind = table.schema[spec.key].dataType
    if not (isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.ArrayType)):
        raise ValueError(f"raw tensor {spec.key!r} is {kind.simpleString()}, not a flat array")
    return table.select("image_id", F.col(spec.key).alias("embedding"))


def features(spark: SparkSession, path: str, ids: DataFrame, cfg: dict) -> dict[str, DataFrame]:
    """The blocks that a selection config names, each as one frame: embedding, patch_scores and the extra ones."""
    wide = lambda block: load(spark, path, ids, EmbeddingSpec.of(block))
    out = {"items": ids}
    if "embedding" in cfg:
        out["embedding"] = wide(cfg["embedding"]).select("image_id", "row_idx", unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    if "patch_scores" in cfg:
        out["patch_scores"] = wide(cfg["patch_scores"]).select("image_id", F.transform("embedding", lambda x: x.cast("double")).alias("distances"))
    for name, block in cfg.get("extra_embeddings", {}).items():
        out[name] = wide(block).select("image_id", "row_idx", unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return out


def labelled_patches(spark: SparkSession, path: str, ids: DataFrame, cfg: dict) -> DataFrame:
    """(image_id, proto_id, distance) of a config whose embedding holds patch labels and whose patch_scores hold their distances, place by place."""
    labels, distances = (load(spark, path, ids, EmbeddingSpec.of(cfg[block])).select("image_id", F.col("embedding").alias(name)) for block, name in (("embedding", "l"), ("patch_scores", "d")))
    both = labels.join(distances, "image_id").select("image_id", F.when(F.size("l") == F.size("d"), F.arrays_zip("l", "d")).otherwise(F.raise_error(F.lit("labels and distances of an image differ in number"))).alias("p"))
    each = both.select("image_id", F.explode("p").alias("p"))
    label = F.when(F.rint("p.l") == F.col("p.l"), F.col("p.l").cast("int")).otherwise(F.raise_error(F.lit("a patch label is not a whole number")))
    return each.select("image_id", label.alias("proto_id"), F.col("p.d").cast("double").alias("distance"))


def matrix_dim(table: DataFrame) -> int:
    """The one length of all vectors; several are an error."""
    sizes = [r[0] for r in table.select(F.size("embedding")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)}")
    return sizes[0] if sizes else 0


def flat_patches(raw: DataFrame) -> DataFrame:
    """(image_id, patch_idx, feature) of (image_id, patch array of rows of vectors): row by row, unit vectors."""
    return raw.select("image_id", F.posexplode(F.flatten("patch")).alias("patch_idx", "feature")).withColumn("feature", unit(F.transform("feature", lambda x: x.cast("double"))))


def save_vectors(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Raw features or a vocabulary (proto_id, centroid, size), as a Parquet table."""
    rows.write.mode(mode).parquet(path)


def features_of(spark: SparkSession, path: str, image_ids: list[str]) -> DataFrame:
    """The raw features of a few images; the ids reach the scan as a filter."""
    return spark.read.parquet(path).where(F.col("image_id").isin(image_ids))


def cached_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("image_id").distinct()


def todo(samples: DataFrame, cached: DataFrame) -> DataFrame:
    """Samples that have no features yet."""
    return samples.join(cached.select("image_id").distinct(), "image_id", "left_anti")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, image_path, row_idx) of a feature manifest."""
    text = spark.read.text(path, wholetext=True)
    schema = "image_ids array<string>, dataset string, representation string, split string, image_paths map<string,string>"
    m = text.select(F.from_json("value", schema).alias("m")).select("m.*")
    return m.select(F.posexplode("image_ids").alias("row_idx", "image_id"), "image_paths").select("image_id", F.try_element_at("image_paths", F.col("image_id")).alias("image_path"), F.col("row_idx").cast("long").alias("row_idx"))


def manifest_text(samples: list[tuple[str, str]], dataset: str, representation: str, split: str) -> str:
    return json.dumps({"image_ids": [i for i, _ in samples], "dataset": dataset, "representation": representation, "split": split, "image_paths": dict(samples)})
