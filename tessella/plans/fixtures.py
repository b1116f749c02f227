"""Inputs of the registered queries, each a pure function of the tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.scalars import family_of
from tessella.functions.vectors import double, unit
from tessella.operators import cluster
from tessella.plans.lineage import ranked
from tessella.sources.tables import table

SLICES, WIDTH = 16, 4


def emb(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, row_idx, label, v): unit vectors."""
    held = table(spark, d, "embeddings")
    rows = held.select(F.col("vec_id").alias("image_id"), "label", double("embedding").alias("raw")).select("image_id", "label", unit("raw").alias("v"))
    # Counted by the files' footers. Vectors are scaled before the ranks, which up to a million rows one task gives.
    return ranked(rows, [F.asc("image_id")], "row_idx", held.count()).select("image_id", (F.col("row_idx") - 1).alias("row_idx"), "label", "v")


def given(spark: SparkSession, d: str) -> DataFrame:
    return cluster.prototypes_by(emb(spark, d), "label")


def patches(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, label, patch_idx, feature): sixteen unit slices of four of each vector."""
    cuts = F.array(*[F.struct(F.lit(i).alias("patch_idx"), F.slice("raw", i * WIDTH + 1, WIDTH).alias("feature")) for i in range(SLICES)])
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label", double("embedding").alias("raw"))
    return rows.select("image_id", "label", F.explode(cuts).alias("p")).select("image_id", "label", "p.patch_idx", unit("p.feature").alias("feature"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return cluster.prototypes_by(patches(spark, d), "label", "feature")


def assigned_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches with proto_id and distance to the vocabulary."""
    return cluster.assigned(patches(spark, d), vocabulary(spark, d), "feature").withColumnRenamed("cluster", "proto_id")


def patch_scores(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, distances) in patch order."""
    listed = F.array_sort(F.collect_list(F.struct("patch_idx", "distance")))
    return assigned_patches(spark, d).groupBy("image_id").agg(F.transform(listed, lambda e: e["distance"]).alias("distances"))


def bag(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, patch_idx, proto_id, distance): an order is an image, its lines are patches."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 16).cast("int").alias("proto_id"), (F.col("l_extendedprice") / 105000.0).alias("distance"))
    return rows.withColumn("patch_idx", F.row_number().over(W.partitionBy("image_id").orderBy("proto_id", "distance")) - 1)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, target, pred): label against nearest prototype; labels 8 and 9 are ignored."""
    near = cluster.assigned(emb(spark, d), given(spark, d))
    return near.select("image_id", F.when(F.col("label") >= 8, 255).otherwise(F.col("label")).cast("int").alias("target"), F.col("cluster").alias("pred"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Report runs: one of each order priority, ratio and seed, with metrics from the orders; 3-MEDIUM is the random baseline."""
    o = table(spark, d, "orders")
    ratio = F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.5)]), (F.month("o_orderdate") % 4 + 1).cast("int"))
    cells = o.groupBy("o_orderpriority", ratio.alias("ratio"), (F.col("o_orderkey") % 3).cast("int").alias("seed")).agg(
        F.round(F.avg("o_totalprice") / 500000, 6).alias("miou"), F.round(F.avg(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))) / 500000, 6).alias("rare_miou"), F.count(F.lit(1)).alias("steps"), F.min("o_orderkey").alias("first")
    )
    method = F.when(F.col("o_orderpriority") == "3-MEDIUM", "random").otherwise(F.lower(F.regexp_replace("o_orderpriority", "[^A-Z]", "")))
    name = F.concat(F.lit("cs_"), method, F.lit("_r"), F.col("ratio").cast("string"), F.lit("_s"), F.col("seed").cast("string"))
    out = cells.select(F.concat(F.lit("x"), F.lpad(F.col("first").cast("string"), 9, "0")).alias("id"), name.alias("name"), method.alias("method"), "ratio", "seed", "miou", "rare_miou", F.col("steps").cast("long").alias("steps"), F.lpad(F.col("first").cast("string"), 12, "0").alias("created_at"))
    full = o.groupBy((F.col("o_orderkey") % 3).cast("int").alias("seed")).agg(F.round(F.max("o_totalprice") / 500000, 6).alias("miou"), F.count(F.lit(1)).cast("long").alias("steps"), F.min("o_orderkey").alias("first"))
    whole = full.select(F.concat(F.lit("y"), F.lpad(F.col("first").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("cs_random_r1.0_s"), F.col("seed").cast("string")).alias("name"), F.lit("full").alias("method"), F.lit(1.0).alias("ratio"), "seed", "miou", F.lit(None).cast("double").alias("rare_miou"), "steps", F.lpad(F.col("first").cast("string"), 12, "0").alias("created_at"))
    fixed = {"dataset": "street", "model": "b0", "recipe": "proxy"}
    return out.unionByName(whole).withColumns({k: F.lit(v) for k, v in fixed.items()} | {"lr": F.lit(1e-4), "epochs": F.lit(100), "family": family_of(F.col("name"))})


SQL: dict[str, str] = {}
RAW = """raw AS (SELECT vec_id AS image_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS raw FROM embeddings),
"""
SQL["emb"] = RAW + """emb AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS row_idx, label,
  list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS v FROM raw)"""
SQL["given"] = SQL["emb"] + """,
protos AS (SELECT label AS proto_id, d, sum(x) AS x, count(*) AS size FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb) GROUP BY label, d),
given AS (SELECT proto_id, list(x / n ORDER BY d) AS centroid, CAST(max(size) AS BIGINT) AS size FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY proto_id)) AS n FROM protos) GROUP BY proto_id),
sims AS (SELECT e.image_id, e.row_idx, e.label, g.proto_id, round(list_sum(list_transform(list_zip(e.v, g.centroid), lambda p: p[1] * p[2])), 9) AS sim FROM emb e, given g),
near AS (SELECT image_id, row_idx, label, CAST(proto_id AS INTEGER) AS cluster, round(greatest(0.0, least(2.0, 1.0 - sim)), 9) AS distance FROM sims
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY sim DESC, proto_id) = 1)"""
CUTS = """cuts AS (SELECT image_id, label, CAST(i AS INTEGER) AS patch_idx, raw[i * 4 + 1 : i * 4 + 4] AS f FROM raw, range(16) t(i)),
patches AS (SELECT image_id, label, patch_idx, list_transform(f, lambda x: x / sqrt(list_sum(list_transform(f, lambda y: y * y)))) AS feature FROM cuts),
psum AS (SELECT label AS proto_id, d, sum(x) AS x, count(*) AS size FROM (SELECT label, unnest(feature) AS x, generate_subscripts(feature, 1) AS d FROM patches) GROUP BY label, d),
vocab AS (SELECT proto_id, list(x / n ORDER BY d) AS centroid FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY proto_id)) AS n FROM psum) GROUP BY proto_id),
psims AS (SELECT p.image_id, p.patch_idx, p.label, p.feature, v.proto_id, round(list_sum(list_transform(list_zip(p.feature, v.centroid), lambda q: q[1] * q[2])), 9) AS sim FROM patches p, vocab v),
pnear AS (SELECT image_id, patch_idx, label, feature, CAST(proto_id AS INTEGER) AS proto_id, round(greatest(0.0, least(2.0, 1.0 - sim)), 9) AS distance FROM psims
  QUALIFY row_number() OVER (PARTITION BY image_id, patch_idx ORDER BY sim DESC, proto_id) = 1),
tails AS (SELECT image_id, list(distance ORDER BY patch_idx) AS distances FROM pnear GROUP BY image_id)"""
SQL["patches"] = RAW + CUTS
SQL["both"] = SQL["given"] + ",\n" + CUTS
SQL["bag"] = """bag AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 16 AS INTEGER) AS proto_id, l_extendedprice / 105000.0 AS distance,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 16, l_extendedprice / 105000.0) - 1 AS patch_idx FROM lineitem)"""
SQL["pixels"] = SQL["given"] + """,
pixels AS (SELECT image_id, CAST(CASE WHEN label >= 8 THEN 255 ELSE label END AS INTEGER) AS target, cluster AS pred FROM near)"""
SQL["runs"] = """cells AS (SELECT o_orderpriority, CAST(list_extract([0.1, 0.2, 0.3, 0.5], month(o_orderdate) % 4 + 1) AS DOUBLE) AS ratio, CAST(o_orderkey % 3 AS INTEGER) AS seed,
  round(avg(o_totalprice) / 500000, 6) AS miou, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) / 500000, 6) AS rare_miou, count(*) AS steps, min(o_orderkey) AS first
  FROM orders GROUP BY ALL),
part1 AS (SELECT 'x' || lpad(first::VARCHAR, 9, '0') AS id, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'random' ELSE lower(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g')) END AS method,
  ratio, seed, miou, rare_miou, CAST(steps AS BIGINT) AS steps, lpad(first::VARCHAR, 12, '0') AS created_at FROM cells),
part2 AS (SELECT 'y' || lpad(min(o_orderkey)::VARCHAR, 9, '0') AS id, 'full' AS method, CAST(1.0 AS DOUBLE) AS ratio, CAST(o_orderkey % 3 AS INTEGER) AS seed, round(max(o_totalprice) / 500000, 6) AS miou,
  CAST(NULL AS DOUBLE) AS rare_miou, CAST(count(*) AS BIGINT) AS steps, lpad(min(o_orderkey)::VARCHAR, 12, '0') AS created_at FROM orders GROUP BY o_orderkey % 3),
runs AS (SELECT id, CASE WHEN method = 'full' THEN 'cs_random' ELSE 'cs_' || method END || '_r' || CASE WHEN method = 'full' THEN '1.0' ELSE ratio::VARCHAR END || '_s' || seed AS name,
  method, ratio, seed, miou, rare_miou, steps, created_at, 'street' AS dataset, 'b0' AS model, 'proxy' AS recipe, CAST(1e-4 AS DOUBLE) AS lr, 100 AS epochs,
  CASE WHEN method = 'full' THEN 'cs_random' ELSE 'cs_' || method END AS family FROM (SELECT * FROM part1 UNION ALL SELECT * FROM part2))"""
