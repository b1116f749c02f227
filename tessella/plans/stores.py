"""Queries of the vector store's and the data sets' frame operators, and of derivations from raw features, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.naming import EmbeddingSpec
from tessella.functions.scalars import budget
from tessella.functions.vectors import double
from tessella.operators import cluster, derive, report, select
from tessella.plans import fixtures as X
from tessella.plans.book import register
from tessella.plans.lineage import cut, shared_folder
from tessella.sources import datasets, ledger, store
from tessella.sources.tables import table


def derivations(spark, d: str) -> DataFrame:
    """A derived table of two methods, one of them with two settings: labels below 7 by cls, others by tail, with K by the label's parity."""
    rows = X.emb(spark, d)
    vector = F.array(F.col("label").cast("float"), F.col("row_idx").cast("float"))
    made = lambda where, **more: store.derivation(rows.where(where).select("image_id", vector.alias("embedding")), dataset="street", split="train", backbone="b", source="cls", **more)
    return made("label < 7", method="cls").unionByName(made("label >= 5 AND label % 2 = 0", method="tail", params={"K": 2})).unionByName(made("label >= 5 AND label % 2 = 1", method="tail", params={"K": 3, "a": "x"}))


KINDS = """kinds AS (SELECT image_id, label, row_idx, 'cls' AS method, '{}' AS params FROM emb WHERE label < 7 UNION ALL SELECT image_id, label, row_idx, 'tail', CASE WHEN label % 2 = 0 THEN '{"K": 2}' ELSE '{"K": 3, "a": "x"}' END FROM emb WHERE label >= 5)"""


@register(f"WITH {KINDS} SELECT DISTINCT 'train' AS split, 'b' AS backbone, method, params FROM kinds", "emb")
def store_available(spark, d):
    return store.available(derivations(spark, d))


@register(f"""WITH {KINDS} SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(label AS DOUBLE) AS first, CAST(row_idx AS DOUBLE) AS second, 2 AS dim FROM kinds WHERE method = 'tail' AND params = '{{"K": 3, "a": "x"}}'""", "emb")
def store_matching(spark, d):
    rows = store.matching(derivations(spark, d), EmbeddingSpec("b", method="tail", params={"a": "x", "K": 3}))
    return rows.select("image_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"), "dim")


@register("SELECT CAST(image_id AS VARCHAR) AS image_id, row_idx, CAST(label AS DOUBLE) AS label FROM emb WHERE label < 7", "emb")
def store_aligned(spark, d):
    """The vectors of all requested ids, each found once and finite."""
    ids = X.emb(spark, d).where("label < 7").select(F.col("image_id").cast("string").alias("image_id"), "row_idx")
    rows = store.aligned(ids, cut(store.matching(derivations(spark, d), EmbeddingSpec("b"))))
    return rows.select("image_id", "row_idx", F.col("embedding")[0].cast("double").alias("label"))


@register("SELECT CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings")
def store_dimension(spark, d):
    return spark.createDataFrame([(store.matrix_dim(table(spark, d, "embeddings")),)], "dim int")


@register("SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def store_missing(spark, d):
    """Ids of a pool that have no vector."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return store.missing(ids, table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("image_id")))


@register("SELECT l_orderkey AS image_id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def store_repeated(spark, d):
    return store.repeated(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id")))


@register("SELECT o_orderkey AS image_id, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def images_todo(spark, d):
    """Samples without features yet."""
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_totalprice").alias("price"))
    return store.todo(samples, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id")))


@register("SELECT o_orderkey AS image_id, o_custkey AS row_idx FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_orderkey IN (SELECT o_orderkey FROM orders))")
def images_restricted(spark, d):
    """The pool's rows of a subset's ids."""
    pool = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("row_idx"))
    subset = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("image_id")).join(pool.select("image_id"), "image_id", "left_semi")
    return datasets.restricted(pool, subset)


@register("SELECT image_id FROM emb ORDER BY md5('0:' || image_id), image_id LIMIT 100", "emb")
def seeded_subsample(spark, d):
    """At most a hundred rows by the seeded draw; the limit is the operator."""
    return select.subsample(X.emb(spark, d).select("image_id"), 100, 0)


@register("""WITH s AS (SELECT 'all' AS name, image_id FROM emb UNION ALL SELECT 'even', image_id FROM emb WHERE image_id % 2 = 0 UNION ALL SELECT 'not odd', image_id FROM emb WHERE image_id % 2 <> 1)
SELECT a.name AS a, b.name AS b, (SELECT count(*) FROM s x WHERE x.name = a.name AND image_id NOT IN (SELECT image_id FROM s y WHERE y.name = b.name)) + (SELECT count(*) FROM s x WHERE x.name = b.name AND image_id NOT IN (SELECT image_id FROM s y WHERE y.name = a.name)) = 0 AS same
FROM (SELECT DISTINCT name FROM s) a JOIN (SELECT DISTINCT name FROM s) b ON a.name < b.name""", "emb")
def subsets_same(spark, d):
    """Whether subsets hold the same ids."""
    rows = cut(X.emb(spark, d).select("image_id"))
    named = {"all": rows, "even": rows.where("image_id % 2 = 0"), "not odd": rows.where("image_id % 2 <> 1")}
    return spark.createDataFrame([(a, b, ledger.same_ids(named[a], named[b])) for a in named for b in named if a < b], "a string, b string, same boolean")


def raw(spark, d: str) -> DataFrame:
    """(image_id, cls, patch): the vector as the class token, and its 16 slices of four as a grid of four by four."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), double("embedding").alias("cls"))
    grid = F.array(*[F.array(*[F.slice("cls", 4 * (4 * y + x) + 1, 4) for x in range(4)]) for y in range(4)])
    return rows.select("image_id", "cls", grid.alias("patch"))


@register("SELECT image_id, patch_idx, CAST(d - 1 AS INTEGER) AS d, round(x, 9) AS x FROM (SELECT image_id, patch_idx, unnest(feature) AS x, generate_subscripts(feature, 1) AS d FROM patches)", "patches")
def flat_patches(spark, d):
    return store.flat_patches(raw(spark, d)).select("image_id", "patch_idx", F.posexplode("feature").alias("d", "x")).select("image_id", "patch_idx", "d", F.round("x", 9).alias("x"))


@register("SELECT image_id, CAST(d - 1 AS INTEGER) AS d, x FROM (SELECT image_id, unnest(raw) AS x, generate_subscripts(raw, 1) AS d FROM raw)", "patches")
def derived_class_token(spark, d):
    return derive.derive(raw(spark, d), "cls").select("image_id", F.posexplode("embedding").alias("d", "x"))


def vocabulary(spark, d: str) -> DataFrame:
    return cut(X.vocabulary(spark, d).select("proto_id", "centroid"))


@register("""WITH c AS (SELECT image_id, proto_id, count(*) / 16.0 AS share FROM pnear GROUP BY ALL) SELECT i.image_id, CAST(k AS INTEGER) AS d, coalesce(CAST(share AS DOUBLE), 0.0) AS x
FROM (SELECT DISTINCT image_id FROM pnear) i CROSS JOIN range(10) t(k) LEFT JOIN c ON c.image_id = i.image_id AND c.proto_id = k""", "patches")
def derived_histogram(spark, d):
    return derive.derive(raw(spark, d), "kmeans_hist", {"K": 10}, vocabulary(spark, d)).select("image_id", F.posexplode("embedding").alias("d", "x"))


@register("SELECT image_id, patch_idx, distance, CAST(proto_id AS INTEGER) AS proto_id FROM pnear", "patches")
def derived_patch_scores(spark, d):
    """The derivations patch_dist and patch_label, place by place."""
    rows, vocab = raw(spark, d), vocabulary(spark, d)
    one = derive.derive(rows, "patch_dist", {}, vocab).select("image_id", F.posexplode("embedding").alias("patch_idx", "distance"))
    two = derive.derive(rows, "patch_label", {}, vocab).select("image_id", F.posexplode("embedding").alias("patch_idx", "proto_id"))
    return one.join(two, ["image_id", "patch_idx"])


@register("""WITH p AS (SELECT a.row_idx AS i, a.label AS own, b.label AS other, avg(1 - list_dot_product(a.v, b.v)) AS m FROM emb a JOIN emb b ON a.row_idx <> b.row_idx GROUP BY ALL),
s AS (SELECT i, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM p GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""", "emb")
def silhouette_of_labels(spark, d):
    """Mean silhouette of the given labels as clusters."""
    value = cluster.silhouette(cut(X.emb(spark, d).select(F.col("label").alias("cluster"), "v")))
    return spark.createDataFrame([(value,)], "s double").select(F.round("s", 6).alias("silhouette"))


@register("""WITH s AS (SELECT DISTINCT label FROM emb WHERE label = 3) SELECT count(*) < 2 AS undefined FROM s""", "emb")
def silhouette_of_one_label(spark, d):
    """A silhouette of one cluster is undefined."""
    rows = cut(X.emb(spark, d).where("label = 3").select(F.col("label").alias("cluster"), "v"))
    return spark.createDataFrame([(cluster.silhouette(rows) is None,)], "undefined boolean")


def raw_table(spark, d: str) -> str:
    """raw() as a feature table in the shared folder."""
    path = shared_folder(spark)
    store.save_vectors(raw(spark, d), path)
    return path


@register("SELECT vec_id AS image_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id IN (3, 17, 42, 99)")
def store_features_of(spark, d):
    """The raw features of a few images, by a filter that reaches the scan."""
    return store.features_of(spark, raw_table(spark, d), [3, 17, 42, 99]).select("image_id", F.round(F.aggregate("cls", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("SELECT vec_id AS image_id FROM embeddings")
def store_cached_ids(spark, d):
    return store.cached_ids(spark, raw_table(spark, d))


@register("SELECT vec_id AS image_id, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS square FROM embeddings")
def store_raw_vectors(spark, d):
    rows = store.raw_vectors(spark, raw_table(spark, d), EmbeddingSpec("b", source="raw", key="cls"))
    return rows.select("image_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"))


@register("""SELECT CAST(image_id AS VARCHAR) AS image_id, row_idx, CAST(CASE WHEN label > 4 THEN 100 + label ELSE label END AS DOUBLE) AS first FROM emb""", "emb")
def store_loaded(spark, d):
    """A derived table after two upserts that overlap, loaded by its spec."""
    path, rows = shared_folder(spark), X.emb(spark, d)
    made = lambda part, value: store.derivation(part.select("image_id", F.array(value.cast("float")).alias("embedding")), dataset="street", split="train", backbone="b", source="cls", method="cls")
    store.upsert(spark, path, made(rows.where("label < 7"), F.col("label")))
    store.upsert(spark, path, made(rows.where("label > 4"), F.col("label") + 100))
    ids = rows.select(F.col("image_id").cast("string").alias("image_id"), "row_idx")
    return store.load(spark, path, ids, EmbeddingSpec("b")).select("image_id", "row_idx", F.col("embedding")[0].cast("double").alias("first"))


@register("SELECT CAST(image_id AS VARCHAR) AS image_id, proto_id, round(CAST(CAST(distance AS FLOAT) AS DOUBLE), 5) AS distance FROM pnear", "patches")
def store_labelled_patches(spark, d):
    """Patch labels with their distances, both read back from the derived table."""
    path, rows, vocab = shared_folder(spark), raw(spark, d), vocabulary(spark, d)
    for method in ("patch_label", "patch_dist"):
        store.upsert(spark, path, store.derivation(derive.derive(rows, method, {}, vocab), dataset="street", split="train", backbone="b", source=derive.TENSOR[method], method=method))
    ids = X.emb(spark, d).select(F.col("image_id").cast("string").alias("image_id"), "row_idx")
    found = store.labelled_patches(spark, path, ids, {"embedding": {"backbone": "b", "method": "patch_label"}, "patch_scores": {"backbone": "b", "method": "patch_dist"}})
    return found.select("image_id", "proto_id", F.round("distance", 5).alias("distance"))


@register("SELECT CAST(proto_id AS INTEGER) AS proto_id, CAST(d - 1 AS INTEGER) AS d, round(x, 6) AS x FROM (SELECT proto_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS d FROM vocab)", "patches")
def vocabulary_read_back(spark, d):
    path, fixed = shared_folder(spark), {"vocab_id": F.lit("v"), "size": F.lit(1).cast("long"), "objective": F.lit(0.0), "meta": F.lit("{}")}
    store.save_vectors(X.vocabulary(spark, d).select("proto_id", "centroid").withColumns(fixed), path)
    return derive.load_vocabulary(spark, path).select("proto_id", F.posexplode("centroid").alias("d", "x")).select("proto_id", "d", F.round("x", 6).alias("x"))


@register("""SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(i AS INTEGER) AS d, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x, 'patch' AS source, 4 AS dim, CAST(length(repeat('x', 12)) AS INTEGER) AS hash_length
FROM (SELECT image_id, d - 1 AS i, x / sqrt(sum(x * x) OVER (PARTITION BY image_id)) AS x FROM (SELECT image_id, d, avg(x) AS x FROM (SELECT image_id, unnest(feature) AS x, generate_subscripts(feature, 1) AS d FROM patches) GROUP BY ALL))""", "patches")
def derivation_run(spark, d):
    """The whole run of a derivation, from a raw table to the derived one and back."""
    path = shared_folder(spark)
    derive.run(spark, raw_table(spark, d), path, shared_folder(spark), dataset="street", split="train", backbone="b", method="patch_mean")
    rows = store.derived(spark, path).select("image_id", "source", "dim", F.length("config_hash").alias("hash_length"), F.posexplode("embedding").alias("d", "x"))
    return rows.select("image_id", "d", F.round(F.col("x").cast("double"), 5).alias("x"), "source", "dim", "hash_length")


@register("""WITH r AS (SELECT image_id, row_number() OVER (ORDER BY md5('7:' || image_id), image_id) AS n, CAST(round_even(0.1::DOUBLE * count(*) OVER (), 0) AS BIGINT) AS b FROM emb), k AS (SELECT image_id FROM r WHERE n <= b)
SELECT 'random' AS method, 0.1::DOUBLE AS ratio, 7 AS seed, CAST(image_id AS VARCHAR) AS image_id, CAST(row_number() OVER (ORDER BY CAST(image_id AS VARCHAR)) - 1 AS INTEGER) AS position FROM k
UNION ALL SELECT 'odd', 0.5, 0, CAST(image_id AS VARCHAR), CAST(row_number() OVER (ORDER BY CAST(image_id AS VARCHAR)) - 1 AS INTEGER) FROM emb WHERE image_id % 2 = 1""", "emb")
def subset_files(spark, d):
    """Two subset files of one folder, written and read by a glob; the first is written twice, and stays."""
    folder, rows = shared_folder(spark), cut(X.emb(spark, d).select("image_id"))
    drawn = cut(select.select("random", {"items": rows}, budget(0.1, rows.count()), 7))
    for ids, meta in ((drawn, {"method": "random", "ratio": 0.1, "seed": 7}), (rows.where("image_id % 2 = 1"), {"method": "odd", "ratio": 0.5, "seed": 0}), (drawn, {"method": "random", "ratio": 0.1, "seed": 7})):
        ledger.save_subset(spark, f"{folder}/street_{meta['method']}_{meta['ratio']:g}_{meta['seed']}.json", ids, {"dataset": "street", **meta})
    return ledger.subsets(spark, f"{folder}/*.json").select("method", "ratio", "seed", "image_id", "position")


@register("""WITH l AS (SELECT id, round(miou + coalesce(rare_miou, 0), 6) AS miou FROM runs WHERE seed = 1 UNION ALL SELECT id, miou FROM runs WHERE seed <> 1) SELECT id AS wandb_run_id, miou FROM l""", "runs")
def ledger_appended(spark, d):
    """The last row of each run after two appends to a ledger."""
    path, rows = shared_folder(spark), X.runs(spark, d)
    ledger.append(rows.select(F.col("id").alias("wandb_run_id"), "miou", "seed"), path)
    ledger.append(rows.where("seed = 1").select(F.col("id").alias("wandb_run_id"), F.round(F.col("miou") + F.coalesce("rare_miou", F.lit(0.0)), 6).alias("miou")), path)
    return report.latest_ledger(spark.read.parquet(path)).select("wandb_run_id", "miou")
