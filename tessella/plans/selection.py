"""Queries over selections, patches and clusters, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.scalars import budget, draw_key
from tessella.functions.vectors import PLACES
from tessella.operators import cluster, derive, diagnostics, greedy, metrics, scoring, select
from tessella.plans import fixtures as X
from tessella.plans.book import register
from tessella.plans.lineage import cut, ranked
from tessella.sources.tables import table

#: The numbers of clusters of the diagnostics' sweep.
SWEEP_KS = (2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 75, 100)


def pick(source: str, order: str, keep: str = "selected") -> str:
    """SQL of quota pruning at ratio 0.2 and balance 0.5 over (image_id, row_idx, cluster, distance)."""
    return f"""WITH b AS (SELECT CAST(round_even(0.2::DOUBLE * count(*), 0) AS BIGINT) AS budget, count(*) AS n FROM {source}),
r AS (SELECT s.*, row_number() OVER (ORDER BY {order}) AS keep_rank, count(*) OVER (PARTITION BY cluster) AS size FROM {source} s),
q AS (SELECT r.*, budget, least(size, CAST(floor(0.5::DOUBLE * size * budget / n) AS BIGINT)) AS quota FROM r, b),
o AS (SELECT q.*, row_number() OVER (PARTITION BY cluster ORDER BY keep_rank) <= quota AS own FROM q),
f AS (SELECT o.*, row_number() OVER (ORDER BY own DESC, keep_rank) <= budget AS {keep} FROM o)"""


def chosen(spark: SparkSession, d: str, **cfg) -> DataFrame:
    rows = cut(X.emb(spark, d))
    n, given = rows.count(), cluster.prototypes_by(rows, "label")
    features = {"items": rows, "embedding": rows, "prototypes": given} | ({"patch_scores": X.patch_scores(spark, d), "cls": rows, "cls_prototypes": given} if cfg.pop("patches", False) else {})
    return select.selector(cfg.pop("method", "prototypicality"))(features, budget(0.2, n), 0, cfg)


COLUMNS = ("image_id", "cluster", "distance", "keep_rank", "quota", "selected")


@register(pick("near", "distance DESC, row_idx") + " SELECT image_id, cluster, distance, keep_rank, quota, selected FROM f", "given")
def select_prototypicality_given(spark, d):
    return chosen(spark, d).select(*COLUMNS)


@register(pick("near", "distance, row_idx") + " SELECT image_id, cluster, distance, keep_rank, quota, selected FROM f", "given")
def select_prototypicality_easy(spark, d):
    return chosen(spark, d, keep="easy").select(*COLUMNS)


TAIL = """WITH scored AS (SELECT n.image_id, n.row_idx, n.cluster, n.distance AS centroid_distance,
  round(list_sum(list_sort(t.distances, 'DESC')[1:CAST(ceil(0.2::DOUBLE * len(t.distances)) AS INTEGER)]) / CAST(ceil(0.2::DOUBLE * len(t.distances)) AS INTEGER), 9) AS distance
  FROM near n JOIN tails t USING (image_id)), """


@register(TAIL + pick("scored", "distance DESC, row_idx")[5:] + " SELECT image_id, cluster, distance, keep_rank, quota, selected FROM f", "both")
def select_patch_tail_given(spark, d):
    return chosen(spark, d, patches=True, score="patch_tail", q=0.2).select(*COLUMNS)


FUSED = TAIL + """pct AS (SELECT image_id, row_idx, cluster, (rank() OVER (ORDER BY centroid_distance) + (count(*) OVER (PARTITION BY centroid_distance) - 1) / 2.0) / count(*) OVER () AS a,
  (rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0) / count(*) OVER () AS b FROM scored),
fused AS (SELECT image_id, row_idx, cluster, round((a + b) / 2, 9) AS distance FROM pct), """


@register(FUSED + pick("fused", "distance DESC, row_idx")[5:] + " SELECT image_id, cluster, distance, keep_rank, quota, selected FROM f", "both")
def select_fused_given(spark, d):
    return chosen(spark, d, patches=True, method="proto_fused", views=["pmean", "tail"], q=0.2).select(*COLUMNS)


@register("SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY md5('7:' || image_id), image_id) AS n, CAST(round_even(0.1::DOUBLE * count(*) OVER (), 0) AS BIGINT) AS b FROM emb) WHERE n <= b", "emb")
def select_random(spark, d):
    return select.select("random", {"items": X.emb(spark, d)}, budget(0.1, table(spark, d, "embeddings").count()), 7)


@register("SELECT image_id FROM emb", "emb")
def select_full(spark, d):
    return select.select("full", {"items": X.emb(spark, d)}, 0)


@register("SELECT c AS cluster, CAST(count(n.image_id) AS BIGINT) AS size FROM (SELECT CAST(i AS INTEGER) AS c FROM range(12) t(i)) LEFT JOIN near n ON n.cluster = c GROUP BY c", "given")
def cluster_sizes(spark, d):
    return diagnostics.cluster_sizes(cluster.assigned(X.emb(spark, d), X.given(spark, d)), 12)


@register(pick("near", "distance DESC, row_idx") + """ SELECT c AS cluster, CAST(count(f.image_id) AS BIGINT) AS size, coalesce(round(avg(distance), 9), 0) AS dist_mean, coalesce(min(distance), 0) AS dist_min,
  coalesce(max(distance), 0) AS dist_max, CAST(count(*) FILTER (selected) AS BIGINT) AS n_selected, coalesce(max(quota), 0) AS quota
  FROM (SELECT CAST(i AS INTEGER) AS c FROM range(12) t(i)) LEFT JOIN f ON f.cluster = c GROUP BY c""", "given")
def clusters_frame(spark, d):
    return diagnostics.clusters_frame(chosen(spark, d), 12)


@register(pick("near", "distance DESC, row_idx") + """, c AS (SELECT i AS c, count(f.image_id) AS size, count(*) FILTER (selected) AS kept, coalesce(max(quota), 0) AS quota FROM range(12) t(i) LEFT JOIN f ON f.cluster = i GROUP BY i)
SELECT count(*) AS n_total, count(*) FILTER (selected) AS n_selected, min(distance) AS distance_min, round(quantile_cont(distance, 0.5), 9) AS distance_median, max(distance) AS distance_max,
  min(distance) FILTER (selected) AS selected_min, max(distance) FILTER (selected) AS selected_max, round(2 * sum(distance), 6) AS inertia, (SELECT min(size) FROM c) AS size_min,
  (SELECT CAST(quantile_cont(size, 0.5) AS DOUBLE) FROM c) AS size_median, (SELECT max(size) FROM c) AS size_max, (SELECT CAST(sum(quota) AS BIGINT) FROM c) AS n_from_quota, (SELECT count(*) FROM c WHERE kept = 0) AS clusters_without_kept FROM f""", "given")
def selection_summary(spark, d):
    return diagnostics.summary(chosen(spark, d), 12)


@register("SELECT image_id, round((rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0) / count(*) OVER (), 9) AS percentile FROM near", "given")
def average_rank_percentile(spark, d):
    return scoring.percentile(cluster.assigned(X.emb(spark, d), X.given(spark, d)), "distance", "p").select("image_id", F.round("p", PLACES).alias("percentile"))


@register(TAIL.rstrip(", ") + """, r AS (SELECT rank() OVER (ORDER BY centroid_distance) + (count(*) OVER (PARTITION BY centroid_distance) - 1) / 2.0 AS a, rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0 AS b FROM scored)
SELECT round(corr(a, b), 6) AS spearman FROM r""", "both")
def spearman_tail_centroid(spark, d):
    rows = cluster.assigned(X.emb(spark, d), X.given(spark, d)).join(X.patch_scores(spark, d).select("image_id", scoring.tail_mean("distances", 0.2).alias("tail")), "image_id")
    return diagnostics.spearman(rows, "tail", "distance")


SUBSETS = """subsets AS (SELECT 'r' || CAST(ratio AS VARCHAR) || 's' || seed AS name, image_id FROM (SELECT image_id, seed, ratio, row_number() OVER (PARTITION BY seed, ratio ORDER BY md5(seed || ':' || image_id), image_id) AS n, round_even(ratio * count(*) OVER (PARTITION BY seed, ratio), 0) AS b
  FROM emb, (SELECT CAST(i AS INTEGER) AS seed FROM range(3) t(i)), (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS ratio)) WHERE n <= b)"""


def subsets(spark, d) -> DataFrame:
    """Nested random draws of three seeds and ratios: the sweep grid of literals times the items."""
    rows = X.emb(spark, d).select("image_id")
    n, out = table(spark, d, "embeddings").count(), None
    for seed in range(3):
        order = ranked(rows.withColumn("k", draw_key(seed, F.col("image_id"))), [F.asc("k"), F.asc("image_id")], "n", n)
        for ratio in (0.1, 0.2, 0.3):
            one = order.where(F.col("n") <= budget(ratio, n)).select(F.lit(f"r{ratio}s{seed}").alias("name"), "image_id")
            out = one if out is None else out.unionByName(one)
    return out


@register("WITH " + SUBSETS + """ SELECT x.name AS a, y.name AS b, round(count(*) FILTER (y.image_id = x.image_id) / CAST(any_value(x.n) + any_value(y.n) - count(*) FILTER (y.image_id = x.image_id) AS DOUBLE), 9) AS jaccard
FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM subsets) x JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM subsets) y ON x.name < y.name GROUP BY x.name, y.name""", "emb")
def jaccard_subsets(spark, d):
    return diagnostics.jaccard(subsets(spark, d))


@register("SELECT image_id, patch_idx, proto_id, distance FROM pnear", "patches")
def patch_assignment(spark, d):
    return X.assigned_patches(spark, d).select("image_id", "patch_idx", "proto_id", "distance")


@register("SELECT image_id, proto_id, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY image_id) AS DOUBLE), 9) AS share FROM pnear GROUP BY image_id, proto_id", "patches")
def patch_histogram(spark, d):
    counts = X.assigned_patches(spark, d).groupBy("image_id", "proto_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("image_id", "proto_id", F.round(F.col("n") / F.sum("n").over(W.partitionBy("image_id")), PLACES).alias("share"))


@register("""WITH m AS (SELECT image_id, d, avg(x) AS x FROM (SELECT image_id, unnest(feature) AS x, generate_subscripts(feature, 1) AS d FROM patches) GROUP BY image_id, d)
SELECT image_id, CAST(d - 1 AS INTEGER) AS d, round(x / sqrt(sum(x * x) OVER (PARTITION BY image_id)), 6) AS x FROM m""", "patches")
def patch_mean(spark, d):
    return scoring.mean_feature(X.patches(spark, d)).select("image_id", F.posexplode("v").alias("d", "x")).select("image_id", "d", F.round("x", 6).alias("x"))


@register("SELECT image_id, array_to_string(list(proto_id ORDER BY patch_idx), ',') AS labels FROM pnear GROUP BY image_id", "patches")
def patch_labels(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("patch_idx", "proto_id")))
    return X.assigned_patches(spark, d).groupBy("image_id").agg(F.array_join(F.transform(listed, lambda e: e["proto_id"].cast("string")), ",").alias("labels"))


@register("SELECT image_id, CAST(i - 1 AS INTEGER) AS patch_idx, distances[i] AS distance FROM tails, range(1, 17) t(i)", "patches")
def patch_distances(spark, d):
    return X.patch_scores(spark, d).select("image_id", F.posexplode("distances").alias("patch_idx", "distance"))


@register("SELECT image_id, q, round(list_sum(list_sort(distances, 'DESC')[1:CAST(ceil(q * 16) AS INTEGER)]) / CAST(ceil(q * 16) AS INTEGER), 9) AS tail FROM tails, (SELECT unnest([0.05, 0.2, 0.5, 1.0])::DOUBLE AS q)", "patches")
def tail_scores(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), scoring.tail_mean("distances", q).alias("tail")) for q in (0.05, 0.2, 0.5, 1.0)])).alias("e")
    return X.patch_scores(spark, d).select("image_id", each).select("image_id", "e.q", "e.tail")


@register("""WITH k AS (SELECT image_id, feature FROM pnear QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY distance DESC, patch_idx) <= 4),
m AS (SELECT image_id, d, avg(x) AS x FROM (SELECT image_id, unnest(feature) AS x, generate_subscripts(feature, 1) AS d FROM k) GROUP BY image_id, d)
SELECT image_id, CAST(d - 1 AS INTEGER) AS d, round(x / sqrt(sum(x * x) OVER (PARTITION BY image_id)), 6) AS x FROM m""", "patches")
def tail_feature(spark, d):
    v = scoring.tail_feature(X.assigned_patches(spark, d), 25)
    return v.select("image_id", F.posexplode("v").alias("d", "x")).select("image_id", "d", F.round("x", 6).alias("x"))


@register("""WITH s AS (SELECT i AS proto_id, count(p.image_id) AS n FROM range(10) t(i) LEFT JOIN pnear p ON p.proto_id = i GROUP BY i)
SELECT min(n) AS min_size, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_size, max(n) AS max_size, count(*) FILTER (n < 0.1 * (SELECT avg(n) FROM s)) AS n_tiny, (SELECT round(avg(distance), 6) FROM pnear) AS mean_distance FROM s""", "patches")
def vocabulary_health(spark, d):
    return diagnostics.vocabulary_health(X.assigned_patches(spark, d), 10)


@register("SELECT image_id, proto_id, round(sum(pow(distance / (SELECT avg(distance) FROM bag), 1.5)), 6) AS mass FROM bag GROUP BY image_id, proto_id", "bag")
def prototype_mass(spark, d):
    return greedy.prototype_mass(X.bag(spark, d), 1.5).select("image_id", "proto_id", F.round("mass", 6).alias("mass"))


ENTROPY = "round(-sum(CASE WHEN m > 0 THEN m / t * ln(m / t) END), 6)"


@register(f"""WITH m AS (SELECT image_id, proto_id, sum(distance / (SELECT avg(distance) FROM bag)) AS mass FROM bag GROUP BY ALL),
p AS (SELECT proto_id, sum(mass) AS pool, sum(mass) FILTER (image_id % 5 = 0) AS sub FROM m GROUP BY proto_id)
SELECT 'pool' AS part, {ENTROPY} AS entropy, count(*) FILTER (m > 0) AS covered FROM (SELECT pool AS m, sum(pool) OVER () AS t FROM p)
UNION ALL SELECT 'subset', {ENTROPY}, count(*) FILTER (m > 0) FROM (SELECT coalesce(sub, 0) AS m, sum(sub) OVER () AS t FROM p)""", "bag")
def prototype_entropy(spark, d):
    mass = greedy.prototype_mass(X.bag(spark, d), 1.0)
    return greedy.balance_summary(mass, mass.where(F.col("image_id") % 5 == 0))


@register("""WITH t AS (SELECT proto_id, sum(n) AS n FROM (SELECT proto_id, count(*) AS n FROM bag GROUP BY proto_id) GROUP BY proto_id)
SELECT proto_id, CAST(n AS BIGINT) AS total, row_number() OVER (ORDER BY n, proto_id) AS rank FROM t QUALIFY rank <= greatest(1, CAST(round_even(0.25::DOUBLE * count(*) OVER (), 0) AS INTEGER))""", "bag")
def rarest_concepts(spark, d):
    return diagnostics.rarest(X.bag(spark, d).groupBy("proto_id").agg(F.count(F.lit(1)).alias("total")), "proto_id", "total", 0.25)


@register("""WITH t AS (SELECT proto_id, count(*) AS n FROM bag GROUP BY proto_id), r AS (SELECT proto_id FROM t QUALIFY row_number() OVER (ORDER BY n, proto_id) <= greatest(1, CAST(round_even(0.25::DOUBLE * count(*) OVER (), 0) AS INTEGER))),
s AS (SELECT DISTINCT 'm' || (image_id % 7) AS name, image_id FROM bag WHERE image_id % 7 < 3), z AS (SELECT name, count(*) AS n_images FROM s GROUP BY name),
c AS (SELECT name, proto_id, count(*) AS c FROM s JOIN bag USING (image_id) WHERE proto_id IN (SELECT proto_id FROM r) GROUP BY name, proto_id),
g AS (SELECT name, count(*) FILTER (c >= 20) AS rare_covered, sum(c) AS c FROM c GROUP BY name), k AS (SELECT count(*) AS rare_total FROM bag WHERE proto_id IN (SELECT proto_id FROM r))
SELECT z.name, n_images, coalesce(rare_covered, 0) AS rare_covered, (SELECT count(*) FROM r) AS n_rare, round(coalesce(c, 0) / CAST(rare_total AS DOUBLE), 9) AS rare_patch_share,
  round(coalesce(c, 0) / CAST(rare_total AS DOUBLE) / (n_images / CAST((SELECT count(DISTINCT image_id) FROM bag) AS DOUBLE)), 9) AS lift FROM z LEFT JOIN g USING (name), k""", "bag")
def concept_coverage(spark, d):
    counts = cut(X.bag(spark, d).groupBy("image_id", "proto_id").agg(F.count(F.lit(1)).alias("n")))
    rare = diagnostics.rarest(counts.groupBy("proto_id").agg(F.sum("n").alias("total")), "proto_id", "total", 0.25)
    items = counts.select("image_id").distinct()
    names = items.where(F.col("image_id") % 7 < 3).select(F.concat(F.lit("m"), (F.col("image_id") % 7).cast("string")).alias("name"), "image_id")
    return diagnostics.coverage(names, counts, items.count(), rare)


@register("SELECT target, pred, count(*) AS n FROM pixels WHERE target <> 255 GROUP BY ALL", "pixels")
def confusion_matrix(spark, d):
    return metrics.confusion(X.pixels(spark, d))


IOU = """WITH m AS (SELECT target, pred, count(*) AS n FROM pixels WHERE target <> 255 GROUP BY ALL),
i AS (SELECT CAST(c AS INTEGER) AS class_id, round(coalesce(sum(n) FILTER (target = c AND pred = c), 0) / CAST(nullif(coalesce(sum(n) FILTER (target = c OR pred = c), 0), 0) AS DOUBLE), 9) AS iou FROM range(12) t(c) LEFT JOIN m ON m.target = c OR m.pred = c GROUP BY c)"""


@register(IOU + " SELECT class_id, iou FROM i", "pixels")
def class_iou(spark, d):
    return metrics.class_iou(metrics.confusion(X.pixels(spark, d)), 12)


@register(IOU + " SELECT round(avg(iou), 6) AS miou, round(avg(iou) FILTER (class_id IN (2, 5, 7)), 6) AS rare_miou, (SELECT round(sum(n) FILTER (target = pred) / CAST(sum(n) AS DOUBLE), 6) FROM m) AS pixel_acc FROM i", "pixels")
def segmentation_summary(spark, d):
    return metrics.summary(cut(metrics.confusion(X.pixels(spark, d))), 12, [2, 5, 7])


@register("""WITH c AS (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS class_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT class_id, n AS pixel_count, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS pixel_freq, CAST(row_number() OVER (ORDER BY n, class_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""")
def rare_classes(spark, d):
    joined = table(spark, d, "lineitem").select("l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return metrics.rare_classes(joined.groupBy(F.substring("p_brand", 7, 10).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n")), 5)


@register("""WITH r AS (SELECT image_id, distance, row_number() OVER (ORDER BY distance, image_id) AS lo, row_number() OVER (ORDER BY distance DESC, image_id) AS hi FROM near)
SELECT 'most' AS side, image_id, distance FROM r WHERE lo <= 5 UNION ALL SELECT 'least', image_id, distance FROM r WHERE hi <= 5""", "given")
def prototypical_ends(spark, d):
    return diagnostics.ends(cluster.assigned(X.emb(spark, d), X.given(spark, d)).select("image_id", "distance"), 5)


@register("""WITH c AS (SELECT image_id, row_idx, round(sum(distance) OVER (ORDER BY row_idx ROWS UNBOUNDED PRECEDING), 9) AS cum FROM near), u AS (SELECT i, round(max(cum) * (2 * i + 1) / 20.0, 9) AS u FROM c, range(10) t(i) GROUP BY i)
SELECT CAST(i AS INTEGER) AS draw, min(image_id) AS image_id FROM (SELECT u.i, c.image_id, c.row_idx, row_number() OVER (PARTITION BY u.i ORDER BY c.row_idx) AS n FROM c JOIN u ON c.cum >= u.u) WHERE n = 1 GROUP BY i""", "given")
def weighted_draw(spark, d):
    """Draws by cumulative weight at fixed points: the first row whose running sum reaches the point."""
    cum = cut(scoring.running_sum(cluster.assigned(X.emb(spark, d), X.given(spark, d)), "distance", "row_idx", "cum").select("image_id", "row_idx", F.round("cum", PLACES).alias("cum")))
    points = cum.agg(F.max("cum").alias("m")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("draw"), F.round(F.col("m") * (2 * i + 1) / 20.0, PLACES).alias("u")))).alias("p")).select("p.*")
    return cum.join(F.broadcast(points), F.col("cum") >= F.col("u")).groupBy("draw").agg(F.min(F.struct("row_idx", "image_id")).alias("m")).select("draw", "m.image_id")


@register("SELECT image_id, patch_idx FROM patches QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('3:' || image_id || ':' || patch_idx), patch_idx) <= 5", "patches")
def patch_sample(spark, d):
    return derive.sampled(X.patches(spark, d), 5, 3).select("image_id", "patch_idx")


SWEEP = """sums AS (SELECT k, label % k AS g, d, sum(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb), (SELECT unnest([2, 3, 4, 5, 7, 10]) AS k) GROUP BY ALL),
groups AS (SELECT k, g, sqrt(sum(x * x)) AS length, max(n) AS n FROM sums GROUP BY k, g), sweep AS (SELECT CAST(k AS INTEGER) AS k, round(sum(2 * (n - length)), 6) AS inertia FROM groups GROUP BY k)"""


def sweep(spark, d: str) -> DataFrame:
    """(k, inertia) of the embeddings dealt to k groups by their labels: twice the summed cosine distance to the groups' mean directions."""
    ks = F.explode(F.array(*[F.lit(k) for k in (2, 3, 4, 5, 7, 10)]))
    each = X.emb(spark, d).select("label", "v", ks.alias("k")).select("k", (F.col("label") % F.col("k")).alias("g"), F.posexplode("v").alias("d", "x"))
    sums = each.groupBy("k", "g", "d").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    groups = sums.groupBy("k", "g").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.max("n").alias("n"))
    return groups.groupBy("k").agg(F.round(F.sum(2.0 * (F.col("n") - F.col("length"))), 6).alias("inertia"))


@register("WITH " + SWEEP + " SELECT k, inertia, round(-100.0 * (inertia - lag(inertia) OVER (ORDER BY k)) / lag(inertia) OVER (ORDER BY k), 6) AS inertia_drop_pct FROM sweep", "emb")
def inertia_drop(spark, d):
    return diagnostics.inertia_drop(sweep(spark, d))


@register("WITH " + SWEEP + """, e AS (SELECT k, ln(k) AS x, inertia AS y, ln(first_value(k) OVER w) AS x0, ln(last_value(k) OVER w) AS x1, first_value(inertia) OVER w AS y0, last_value(inertia) OVER w AS y1 FROM sweep WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT k AS elbow_k FROM e ORDER BY round(abs(1.0 - (x - x0) / (x1 - x0) - (y - y1) / (y0 - y1)), 9) DESC, k LIMIT 1""", "emb")
def elbow(spark, d):
    return diagnostics.elbow(sweep(spark, d))


@register()
def fit_prototypes(spark, d):
    """Fitted spherical k-means and the selection by it."""
    rows = X.emb(spark, d)
    return select.prototypicality({"items": rows, "embedding": rows}, budget(0.2, rows.count()), 0, {"k": 10, "n_init": 3}).select(*COLUMNS)


@register()
def fit_vocabulary(spark, d):
    """A patch vocabulary of eight prototypes from a sample of five patches an image, by mean distance."""
    rows = derive.sampled(X.patches(spark, d), 5, 3).select((F.col("image_id") * X.SLICES + F.col("patch_idx")).alias("row_idx"), F.col("feature").alias("v"))
    found = cluster.fit(rows, 8, restarts=3, reseed="any")
    return cluster.as_prototypes(spark, found.centroids).select("proto_id", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@register()
def select_patch_balance(spark, d):
    patches = cut(X.assigned_patches(spark, d).select("image_id", "proto_id", "distance"))
    rows = X.emb(spark, d)
    return select.patch_balance({"items": rows, "patches": patches}, budget(0.1, table(spark, d, "embeddings").count()), 0, {"K": 10}).where("selected").select("image_id", "keep_rank")


@register()
def cluster_diagnostics(spark, d):
    """Silhouette and inertia over 16 values of k, three seeds and ten restarts each."""
    return diagnostics.diagnose(cut(X.emb(spark, d)), SWEEP_KS, (0, 1, 2))


@register()
def k_stability(spark, d):
    rows = cut(X.emb(spark, d))
    return diagnostics.stability(rows, (5, 10, 20, 50, 100), (0, 1, 2), budget(0.2, rows.count()), 20)


def tail_sql(q: float) -> str:
    m = f"CAST(ceil({q}::DOUBLE * len(t.distances)) AS INTEGER)"
    return f"round(list_sum(list_sort(t.distances, 'DESC')[1:{m}]) / {m}, 9)"


TAIL_QS = (0.2, 1.0)
CHECKS = "WITH s AS (SELECT n.image_id, n.row_idx, n.cluster, n.distance AS t, " + ", ".join(f"{tail_sql(q)} AS t{i}" for i, q in enumerate(TAIL_QS)) + " FROM near n JOIN tails t USING (image_id)), " + ", ".join(
    f"d{c} AS (SELECT image_id, row_idx, cluster, {c} AS distance FROM s), p{c} AS ({pick(f'd{c}', 'distance DESC, row_idx')} SELECT image_id FROM f WHERE selected), k{c} AS (SELECT image_id, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM s)"
    for c in ("t", *(f"t{i}" for i in range(len(TAIL_QS))))
) + " " + " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, 0.2::DOUBLE AS ratio, (SELECT round(corr(a.r, b.r), 6) FROM kt a JOIN kt{i} b USING (image_id)) AS spearman_tail_vs_centroid, (SELECT CAST(count(*) AS DOUBLE) / (2 * (SELECT count(*) FROM pt) - count(*)) FROM pt JOIN pt{i} USING (image_id)) AS jaccard_vs_centroid_subset"
    for i, q in enumerate(TAIL_QS)
)


@register(CHECKS, "both")
def patch_tail_checks(spark, d):
    scores = cluster.assigned(X.emb(spark, d), X.given(spark, d)).select("image_id", "row_idx", "cluster", "distance")
    return diagnostics.tail_checks(cut(scores), cut(X.patch_scores(spark, d)), TAIL_QS, (0.2,))


@register("""WITH g AS (SELECT l_orderkey % 40 AS image_id, l_linenumber % 7 AS y, l_suppkey % 9 AS x, min(l_partkey) AS p, max(l_partkey) AS q FROM lineitem GROUP BY ALL),
px AS (SELECT image_id, y, x, CASE WHEN p % 11 = 0 THEN 255 ELSE CAST((x + p % 2) // 4 AS INTEGER) END AS target, CAST((x + q % 3) // 4 AS INTEGER) AS pred FROM g),
o AS (SELECT a - 1 AS dy, b - 1 AS dx FROM range(3) s(a), range(3) t(b) WHERE a <> 1 OR b <> 1),
mk AS (SELECT c.image_id, c.y, c.x, c.target, c.pred, bool_or(n.target IS NULL OR n.target <> c.target) AS te, bool_or(n.pred IS NULL OR n.pred <> c.pred) AS pe, coalesce(bool_or(n.target = 255), false) AS void
  FROM px c CROSS JOIN o LEFT JOIN px n ON n.image_id = c.image_id AND n.y = c.y + o.dy AND n.x = c.x + o.dx GROUP BY ALL),
ok AS (SELECT * FROM mk WHERE target <> 255 AND NOT void),
gt AS (SELECT image_id, y, x, target AS c FROM ok WHERE te), pr AS (SELECT image_id, y, x, pred AS c FROM ok WHERE pe),
re AS (SELECT image_id, c, avg(CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.image_id = gt.image_id AND pr.c = gt.c AND (pr.y - gt.y) ** 2 + (pr.x - gt.x) ** 2 <= 9) THEN 1.0 ELSE 0.0 END) AS r FROM gt GROUP BY image_id, c),
pp AS (SELECT image_id, c, avg(CASE WHEN EXISTS (SELECT 1 FROM gt WHERE pr.image_id = gt.image_id AND pr.c = gt.c AND (pr.y - gt.y) ** 2 + (pr.x - gt.x) ** 2 <= 9) THEN 1.0 ELSE 0.0 END) AS p FROM pr GROUP BY image_id, c),
sc AS (SELECT image_id, round(avg(CASE WHEN coalesce(p, 0) + r = 0 OR p IS NULL THEN 0.0 ELSE 2 * p * r / (p + r) END), 9) AS boundary_f FROM re LEFT JOIN pp USING (image_id, c) GROUP BY image_id)
SELECT image_id, boundary_f FROM (SELECT DISTINCT image_id FROM px) LEFT JOIN sc USING (image_id)""")
def boundary_f(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("image_id"), (F.col("l_linenumber") % 7).alias("y"), (F.col("l_suppkey") % 9).alias("x")).agg(F.min("l_partkey").alias("p"), F.max("l_partkey").alias("q"))
    third = lambda e: F.floor(e / 4).cast("int")
    px = g.select("image_id", "y", "x", F.when(F.col("p") % 11 == 0, 255).otherwise(third(F.col("x") + F.col("p") % 2)).alias("target"), third(F.col("x") + F.col("q") % 3).alias("pred"))
    return metrics.boundary_f(px)
