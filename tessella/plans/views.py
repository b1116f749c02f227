"""Queries of selections over several views, second vocabularies, derivations and image headers, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import budget
from tessella.functions.vectors import PLACES
from tessella.operators import cluster, derive, diagnostics, scoring, select
from tessella.plans import fixtures as X
from tessella.plans.book import register
from tessella.plans.lineage import cut
from tessella.plans.selection import COLUMNS, TAIL, pick
from tessella.sources import images, store
from tessella.sources.tables import table


def nearest_sql(rows: str, vectors: str, v: str, group: str, name: str, more: str = "") -> str:
    """SQL of name: rows of `vectors` with cluster and distance to the mean directions of the groups of `rows`."""
    return f"""{name}_s AS (SELECT {group} AS g, d, sum(x) AS x FROM (SELECT label, unnest({v}) AS x, generate_subscripts({v}, 1) AS d FROM {rows}) GROUP BY ALL),
{name}_p AS (SELECT g, list(x / n ORDER BY d) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY g)) AS n FROM {name}_s) GROUP BY g),
{name} AS (SELECT image_id, {more}CAST(g AS INTEGER) AS cluster, round(greatest(0.0, least(2.0, 1.0 - sim)), {PLACES}) AS distance FROM (SELECT e.*, p.g, round(list_dot_product(e.{v}, p.c), {PLACES}) AS sim FROM {vectors} e, {name}_p p)
  QUALIFY row_number() OVER (PARTITION BY image_id{', patch_idx' if 'patch_idx' in more else ''} ORDER BY sim DESC, g) = 1)"""


FUSED3 = "WITH " + nearest_sql("emb", "emb", "v", "label % 4", "other") + ", " + TAIL[5:] + """pct AS (SELECT s.image_id, row_idx, s.cluster, (rank() OVER (ORDER BY centroid_distance) + (count(*) OVER (PARTITION BY centroid_distance) - 1) / 2.0) / count(*) OVER () AS a,
  (rank() OVER (ORDER BY s.distance) + (count(*) OVER (PARTITION BY s.distance) - 1) / 2.0) / count(*) OVER () AS b, (rank() OVER (ORDER BY o.distance) + (count(*) OVER (PARTITION BY o.distance) - 1) / 2.0) / count(*) OVER () AS c FROM scored s JOIN other o USING (image_id)),
fused AS (SELECT image_id, row_idx, cluster, round({value}, 9) AS distance FROM pct), """
PICKED = pick("fused", "distance DESC, row_idx")[5:] + " SELECT image_id, cluster, distance, keep_rank, quota, selected FROM f"


def three_views(spark, d: str, fusion: str) -> DataFrame:
    rows = X.emb(spark, d)
    features = {"embedding": rows, "prototypes": X.given(spark, d), "patch_scores": X.patch_scores(spark, d), "cls": rows, "cls_prototypes": cluster.prototypes_by(rows.withColumn("g", F.col("label") % 4), "g")}
    return select.proto_fused(features, budget(0.2, table(spark, d, "embeddings").count()), 0, {"q": 0.2, "fusion": fusion}).select(*COLUMNS)


@register(FUSED3.replace("{value}", "(c + a + b) / 3") + PICKED, "both")
def select_fused_three_views(spark, d):
    return three_views(spark, d, "meanrank")


@register(FUSED3.replace("{value}", "least(a, b, c)") + PICKED, "both")
def select_fused_least_rank(spark, d):
    return three_views(spark, d, "minrank")


@register("WITH kept AS (SELECT image_id, label, feature FROM pnear QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY distance DESC, patch_idx) <= 4),\nmean AS (SELECT image_id, label, d, avg(x) AS x FROM (SELECT image_id, label, unnest(feature) AS x, generate_subscripts(feature, 1) AS d FROM kept) GROUP BY ALL),\n"
  "tf AS (SELECT image_id, label, list(x / n ORDER BY d) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY image_id)) AS n FROM mean) GROUP BY image_id, label),\n"
  + nearest_sql("tf", "tf", "v", "label", "own") + """,
scored AS (SELECT o.image_id, row_number() OVER (ORDER BY o.image_id) - 1 AS row_idx, o.cluster, round(list_sum(list_sort(t.distances, 'DESC')[1:5]) / 5, 9) AS distance FROM own o JOIN tails t USING (image_id)), """
  + pick("scored", "distance DESC, row_idx")[5:] + " SELECT image_id, cluster, distance, keep_rank, quota, selected FROM f", "patches")
def select_tail_feature_clusters(spark, d):
    """Patch tails balanced over clusters of the images' tail features, here by given prototypes."""
    patches = X.assigned_patches(spark, d)
    rows = cut(X.emb(spark, d).select("image_id", "row_idx", "label").join(scoring.tail_feature(patches, 25), "image_id"))
    features = {"embedding": rows.drop("label"), "prototypes": cluster.prototypes_by(rows, "label"), "patch_scores": X.patch_scores(spark, d)}
    return select.prototypicality(features, budget(0.2, rows.count()), 0, {"score": "patch_tail", "q": 0.3}).select(*COLUMNS)


SECOND = nearest_sql("patches", "patches", "feature", "label % 5", "pother", "patch_idx, ")
TAILS2 = SECOND + """,
t2 AS (SELECT image_id, list_sum(list_sort(list(distance), 'DESC')[1:4]) / 4 AS b FROM pother GROUP BY image_id), t1 AS (SELECT image_id, list_sum(list_sort(distances, 'DESC')[1:4]) / 4 AS a FROM tails),
two AS (SELECT image_id, round(a, 9) AS a, round(b, 9) AS b FROM t1 JOIN t2 USING (image_id)),
r AS (SELECT image_id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b, row_number() OVER (ORDER BY a DESC, image_id) AS p, row_number() OVER (ORDER BY b DESC, image_id) AS q, count(*) OVER () AS n FROM two)"""


def two_vocabularies(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Tail scores by the prototypes of all labels, and by those of five groups of labels."""
    patches = X.patches(spark, d)
    other = cluster.assigned(patches, cluster.prototypes_by(patches.withColumn("g", F.col("label") % 5), "g", "feature"), "feature")
    listed = F.array_sort(F.collect_list(F.struct("patch_idx", "distance")))
    tails = other.groupBy("image_id").agg(F.transform(listed, lambda e: e["distance"]).alias("distances"))
    score = lambda rows: rows.select("image_id", scoring.tail_mean("distances", 0.25).alias("score"))
    return score(X.patch_scores(spark, d)), score(tails)


@register(f"WITH {TAILS2} SELECT round(corr(a, b), 6) AS spearman FROM r", "patches")
def vocabularies_agree(spark, d):
    return diagnostics.compared(*two_vocabularies(spark, d))


@register(f"""WITH {TAILS2}, z AS (SELECT DISTINCT CAST(round_even(ratio * n, 0) AS BIGINT) AS z FROM r, (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS ratio)),
j AS (SELECT z, count(*) FILTER (p <= z AND q <= z) / CAST(count(*) FILTER (p <= z OR q <= z) AS DOUBLE) AS j FROM r, z GROUP BY z)
SELECT 'five groups' AS name, (SELECT round(corr(a, b), 6) FROM r) AS spearman, (SELECT round(avg(j), 9) FROM j) AS jaccard""", "patches")
def vocabulary_sensitivity(spark, d):
    one, two = two_vocabularies(spark, d)
    n = table(spark, d, "embeddings").count()
    return diagnostics.sensitivity(one, {"five groups": two}, [budget(r, n) for r in (0.1, 0.2, 0.3)])


@register("""SELECT CAST(image_id AS VARCHAR) AS image_id, coalesce(url, '') AS image_path, 'patch' AS source, 'patch_mean' AS method, '{"a": 1}' AS params, 4 AS dim, '0123456789ab' AS config_hash
FROM emb LEFT JOIN (SELECT page_id, min(url) AS url FROM pages GROUP BY page_id) ON page_id = image_id""", "emb")
def derivation_rows(spark, d):
    """Patch means as rows of the derived table, with the paths of a manifest that does not hold every image."""
    vectors = scoring.mean_feature(X.patches(spark, d)).withColumnRenamed("v", "embedding")
    manifest = table(spark, d, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("image_path"))
    rows = store.derivation(derive.with_paths(vectors, manifest), dataset="street", split="train", backbone="b", source=derive.TENSOR["patch_mean"], method="patch_mean", params={"a": 1}, config_hash="0123456789ab")
    return rows.select("image_id", "image_path", "source", "method", "params", "dim", "config_hash")


BPP = """f AS (SELECT page_id, 29 + octet_length(encode(html)) AS bytes, CAST(16 + page_id % 97 AS INTEGER) AS width, CAST(9 + page_id % 31 AS INTEGER) AS height FROM pages),
s AS (SELECT *, round(8.0::DOUBLE * bytes / (width * height), 9) AS bpp FROM f), o AS (SELECT *, row_number() OVER (ORDER BY bpp DESC, lpad(page_id::VARCHAR, 12, '0')) AS keep_rank, CAST(round_even(0.1::DOUBLE * count(*) OVER (), 0) AS BIGINT) AS b FROM s)"""


@register(f"WITH {BPP} SELECT lpad(page_id::VARCHAR, 12, '0') AS path, bytes, width, height, 'png' AS kind, bpp, keep_rank FROM o WHERE keep_rank <= b")
def select_bits_per_pixel(spark, d):
    """The tenth of most bits a pixel of image files that Spark makes of the pages: a PNG's header of a size by page_id, before the page's bytes."""
    side = lambda n, least: F.lpad(F.hex((least + F.col("page_id") % n).cast("long")), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side(97, 16), side(31, 9), F.lit("0802000000")))
    files = table(spark, d, "pages").select(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"), F.concat(head, F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).alias("content"))
    found = cut(images.header_sizes(files))
    return images.choose(found, budget(0.1, found.count())).where("selected").drop("selected")
