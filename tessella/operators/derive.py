"""Derivations of raw features, (image_id, cls, patch): each gives (image_id, embedding), by a registry."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.naming import VocabSpec, config_hash
from tessella.operators import cluster, scoring
from tessella.sources import ledger, store

RESTARTS = 3


def sampled(patches: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n patches of each image, the least by a digest of seed, image and place; more come first to none."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string"), F.col("patch_idx").cast("string")))
    return patches.withColumn("__n", F.row_number().over(W.partitionBy("image_id").orderBy(key, "patch_idx"))).where(F.col("__n") <= n).drop("__n")


def fit_vocabulary(raw: DataFrame, spec: VocabSpec) -> DataFrame:
    """(vocab_id, proto_id, centroid, size, objective, meta) of prototypes fitted to a sample of the patches; objective is the mean distance."""
    sample = sampled(store.flat_patches(raw), spec.n_sample, spec.seed).select(F.xxhash64("image_id", "patch_idx").alias("row_idx"), F.col("feature").alias("v")).persist()
    n = sample.count()
    found = cluster.fit(sample, spec.K, spec.seed, RESTARTS, reseed="any")
    prototypes = cluster.as_prototypes(raw.sparkSession, found.centroids)
    sizes = cluster.assigned(sample, prototypes).groupBy(F.col("cluster").alias("proto_id")).agg(F.count(F.lit(1)).alias("size"))
    meta = json.dumps({**spec.params(), "backbone": spec.backbone, "n_patches": n, "converged": found.converged}, sort_keys=True)
    fixed = {"vocab_id": F.lit(spec.vocab_id()), "objective": F.lit(found.objective / max(n, 1)), "meta": F.lit(meta)}
    out = prototypes.join(sizes, "proto_id", "left").select(fixed["vocab_id"].alias("vocab_id"), "proto_id", "centroid", F.coalesce("size", F.lit(0)).alias("size"), fixed["objective"].alias("objective"), fixed["meta"].alias("meta"))
    out = out.sparkSession.createDataFrame(out.collect(), out.schema)  # K rows
    sample.unpersist()
    return out


def vocabulary(spark: SparkSession, folder: str, spec: VocabSpec, raw: DataFrame) -> DataFrame:
    """The vocabulary of a spec: read if its table is there, else fitted and written. The raw features are those of the train split."""
    path = f"{folder}/{spec.vocab_id()}"
    if not ledger.exists(spark, path):
        store.save_vectors(fit_vocabulary(raw, spec), path, "error")
    return load_vocabulary(spark, path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vocab_id string, proto_id int, centroid array<double>, size long, objective double, meta string").parquet(path)


def assignment(raw: DataFrame, vocab: DataFrame) -> DataFrame:
    """(image_id, patch_idx, feature, proto_id, distance) of every patch."""
    return cluster.assigned(store.flat_patches(raw), vocab.select("proto_id", "centroid"), "feature").withColumnRenamed("cluster", "proto_id")


def listed(patches: DataFrame, value: str) -> DataFrame:
    """A value of each image's patches as an array in patch order."""
    return patches.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("patch_idx", value))), lambda e: e[value]).alias("embedding"))


def class_token(raw: DataFrame, vocab: DataFrame | None, params: dict) -> DataFrame:
    return raw.select("image_id", F.col("cls").alias("embedding"))


def patch_mean(raw: DataFrame, vocab: DataFrame | None, params: dict) -> DataFrame:
    return scoring.mean_feature(store.flat_patches(raw)).withColumnRenamed("v", "embedding")


def patch_histogram(raw: DataFrame, vocab: DataFrame | None, params: dict) -> DataFrame:
    """The share of an image's patches at each of K prototypes."""
    counts = assignment(raw, vocab).groupBy("image_id", "proto_id").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("proto_id", "n"))).alias("m"), F.sum("n").alias("total"))
    share = F.transform(F.sequence(F.lit(0), F.lit(int(params["K"]) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("total"))
    return held.select("image_id", share.alias("embedding"))


def patch_distances(raw: DataFrame, vocab: DataFrame | None, params: dict) -> DataFrame:
    return listed(assignment(raw, vocab), "distance")


def patch_labels(raw: DataFrame, vocab: DataFrame | None, params: dict) -> DataFrame:
    return listed(assignment(raw, vocab), "proto_id")


def tail_feature(raw: DataFrame, vocab: DataFrame | None, params: dict) -> DataFrame:
    return scoring.tail_feature(assignment(raw, vocab), float(params["tail_pct"])).withColumnRenamed("v", "embedding")


DERIVATIONS: dict[str, Callable[[DataFrame, DataFrame | None, dict], DataFrame]] = {
    "cls": class_token, "patch_mean": patch_mean, "kmeans_hist": patch_histogram, "patch_dist": patch_distances, "patch_label": patch_labels, "tail_feature": tail_feature,
}
#: The raw tensor that each derivation is made of.
TENSOR = {method: "cls" if method == "cls" else "patch" for method in DERIVATIONS}
BY_VOCABULARY = ("kmeans_hist", "patch_dist", "patch_label", "tail_feature")


def derive(raw: DataFrame, method: str, params: dict | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """(image_id, embedding) of a method of the registry; those by a vocabulary need one."""
    if method not in DERIVATIONS:
        raise ValueError(f"unknown derivation {method!r}; there are {sorted(DERIVATIONS)}")
    if method in BY_VOCABULARY and vocab is None:
        raise ValueError(f"derivation {method!r} needs a vocabulary")
    return DERIVATIONS[method](raw, vocab, params or {})


def with_paths(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """Vectors with the image_path of a manifest (image_id, image_path), each id once there; empty where it has none."""
    paths = manifest.groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.min("image_path").alias("image_path"))
    own = vectors.withColumn("image_id", F.col("image_id").cast("string"))
    return own.join(paths, "image_id", "left").withColumn("image_path", F.coalesce("image_path", F.lit("")))


def run(spark: SparkSession, raw_path: str, derived_path: str, vocab_folder: str, *, dataset: str, split: str, backbone: str, method: str, params: dict | None = None, train_path: str | None = None, manifest: str | None = None, cfg: dict | None = None) -> None:
    """Derive from a raw table and upsert into the derived one. A vocabulary is fitted on the train split's raw table, if it is not there yet.

    The rows' source is the tensor that they are made of, their config_hash that of cfg (the run's own settings without one), and their
    image_path comes from the manifest; without one, or for ids that it does not hold, it is empty.
    """
    params = dict(params or {})
    raw, vocab = spark.read.parquet(raw_path), None
    if method in BY_VOCABULARY:
        spec = VocabSpec(backbone, **{k: params[k] for k in ("K", "n_sample", "seed") if k in params})
        params = spec.params() | params
        vocab = vocabulary(spark, vocab_folder, spec, spark.read.parquet(train_path or raw_path))
    vectors = derive(raw, method, params, vocab)
    if manifest is not None:
        vectors = with_paths(vectors, store.manifest(spark, manifest))
    settings = cfg if cfg is not None else {"dataset": dataset, "split": split, "backbone": backbone, "method": method, "params": params}
    rows = store.derivation(vectors, dataset=dataset, split=split, backbone=backbone, source=TENSOR[method], method=method, params=params, config_hash=config_hash(settings))
    store.upsert(spark, derived_path, rows)
