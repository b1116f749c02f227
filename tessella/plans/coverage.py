"""Queries of the coverage selectors, each beside its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.scalars import budget
from tessella.functions.vectors import PLACES
from tessella.operators import coverage, select, semdedup
from tessella.plans import fixtures as X
from tessella.plans.book import register
from tessella.plans.lineage import cut
from tessella.sources.tables import table


def share(spark, d: str, ratio: float) -> int:
    return budget(ratio, table(spark, d, "embeddings").count())


@register(f"""WITH RECURSIVE n AS (SELECT CAST(round_even(0.1::DOUBLE * count(*), 0) AS BIGINT) AS b FROM emb),
s AS (SELECT image_id, row_idx, v, 'inf'::DOUBLE AS gap, 1 AS step, first_value(row_idx) OVER w AS p, first_value(v) OVER w AS c, CAST(NULL AS DOUBLE) AS g FROM emb WINDOW w AS (ORDER BY md5('0:' || image_id), row_idx)
  UNION ALL SELECT image_id, row_idx, v, gap, step, first_value(row_idx) OVER w, first_value(v) OVER w, first_value(gap) OVER w FROM
  (SELECT image_id, row_idx, v, CASE WHEN row_idx = p THEN -1.0 ELSE least(gap, round(sqrt(greatest(0.0, 2.0 - 2.0 * list_dot_product(v, c))), {PLACES})) END AS gap, step + 1 AS step FROM s, n WHERE step < b) WINDOW w AS (ORDER BY gap DESC, row_idx))
SELECT image_id, CAST(step AS BIGINT) AS keep_rank, round(g, 6) AS gap FROM s WHERE row_idx = p""", "emb")
def select_kcenter(spark, d):
    rows = X.emb(spark, d)
    found = select.k_center({"embedding": rows}, share(spark, d, 0.1), 0, {})
    return found.where("selected").select("image_id", "keep_rank", F.round("gap", 6).alias("gap"))


@register()
def select_kcenter_composed(spark, d):
    """The same over composable centres of blocks, within 2 + 1 of the best radius."""
    found = select.k_center({"embedding": X.emb(spark, d)}, share(spark, d, 0.02), 0, {"eps": 1.0})
    return found.where("selected").select("image_id", "keep_rank", F.round("gap", 6).alias("gap"))


TAU = 0.995


@register(f"""WITH RECURSIVE rows AS (SELECT image_id * 16 + patch_idx AS id, image_id, patch_idx, proto_id, distance, feature FROM pnear),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM rows a JOIN rows b ON a.proto_id = b.proto_id AND a.id <> b.id WHERE round(list_dot_product(a.feature, b.feature), {PLACES}) >= {TAU}),
c AS (SELECT id, id AS root FROM rows UNION SELECT e.b, c.root FROM c JOIN e ON c.id = e.a WHERE c.root < e.b),
g AS (SELECT id, min(root) AS component FROM c GROUP BY id)
SELECT image_id, patch_idx, component, count(*) OVER (PARTITION BY component) AS group_size, row_number() OVER (PARTITION BY component ORDER BY distance DESC, id) = 1 AS kept FROM g JOIN rows USING (id)""", "patches")
def semdedup_patches(spark, d):
    """Near copies among the patches of one concept; of each group the farthest from its prototype stays."""
    rows = X.assigned_patches(spark, d).select("image_id", "patch_idx", (F.col("image_id") * X.SLICES + F.col("patch_idx")).alias("row_idx"), F.col("proto_id").alias("cluster"), "distance", F.col("feature").alias("v"))
    return semdedup.keep_one(cut(rows), TAU).select("image_id", "patch_idx", "component", "group_size", "kept")


@register(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a.row_idx AS a, b.row_idx AS b FROM near a JOIN near b ON a.cluster = b.cluster AND a.row_idx <> b.row_idx JOIN emb x ON x.row_idx = a.row_idx JOIN emb y ON y.row_idx = b.row_idx WHERE round(list_dot_product(x.v, y.v), {PLACES}) >= 0.3),
c AS (SELECT row_idx, row_idx AS root FROM near UNION SELECT e.b, c.root FROM c JOIN e ON c.row_idx = e.a WHERE c.root < e.b),
g AS (SELECT row_idx, min(root) AS component FROM c GROUP BY row_idx),
k AS (SELECT image_id, row_idx, component, row_number() OVER (PARTITION BY component ORDER BY distance DESC, row_idx) = 1 AS kept FROM g JOIN near USING (row_idx)),
o AS (SELECT *, row_number() OVER (ORDER BY kept DESC, md5('3:' || image_id), row_idx) AS keep_rank, CAST(round_even(0.2::DOUBLE * count(*) OVER (), 0) AS BIGINT) AS b FROM k)
SELECT image_id, component, kept, keep_rank FROM o WHERE keep_rank <= b""", "given")
def select_semdedup(spark, d):
    """A seeded draw of 20 % from the embeddings without near copies. No two of these vectors have a cosine of 0.95, so the query takes 0.3."""
    found = select.sem_dedup({"embedding": X.emb(spark, d), "prototypes": X.given(spark, d)}, share(spark, d, 0.2), 3, {"tau": 0.3})
    return found.where("selected").select("image_id", "component", "kept", "keep_rank")


@register()
def select_patch_coverage(spark, d):
    """Threshold passes within 0.1, concepts by rarity, saturated at four patches."""
    items = X.emb(spark, d).select("image_id", "row_idx")
    found = select.patch_coverage({"items": items, "patches": X.assigned_patches(spark, d)}, share(spark, d, 0.1), 0, {"saturation": 4.0, "eps": 0.1})
    return found.where("selected").select("image_id", "keep_rank", F.round("gain", 6).alias("gain"))


@register("""WITH n AS (SELECT image_id, proto_id, count(*) AS n FROM bag GROUP BY ALL), w AS (SELECT proto_id, pow(sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM n), -1.0) AS w FROM n GROUP BY proto_id),
m AS (SELECT proto_id, sum(n / 4.0) AS mass, coalesce(sum(n / 4.0) FILTER (image_id % 997 = 0), 0) AS own FROM n GROUP BY proto_id)
SELECT round(sum(w * (1 - exp(-own))), 6) AS value, round(sum(w * (1 - exp(-mass))), 6) AS whole, count(*) FILTER (own > 0) AS met FROM m JOIN w USING (proto_id)""", "bag")
def patch_coverage_value(spark, d):
    counted = cut(coverage.counts(X.bag(spark, d)))
    chosen = counted.select("image_id").where(F.col("image_id") % 997 == 0)
    return coverage.value(coverage.masses(counted, 4.0), coverage.weights(counted, 1.0), chosen)


@register()
def select_zcore(spark, d):
    found = select.z_core({"embedding": X.emb(spark, d)}, share(spark, d, 0.1), 0, {})
    return found.where("selected").select("image_id", "keep_rank", "votes", "score")
