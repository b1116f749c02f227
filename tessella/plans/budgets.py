"""Queries of budgets over classes and regions, and of comparisons between methods, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.scalars import budget
from tessella.operators import balance, report, stats
from tessella.plans import fixtures as X
from tessella.plans.book import register
from tessella.plans.lineage import cut
from tessella.sources.tables import table


@register("""WITH z AS (SELECT source AS class_id, count(*) AS size FROM documents GROUP BY source), b AS (SELECT CAST(round_even(0.6::DOUBLE * sum(size), 0) AS BIGINT) AS b FROM z),
l AS (SELECT l, sum(least(size, l)) AS filled FROM z, range((SELECT max(size) + 1 FROM z)) t(l) GROUP BY l), m AS (SELECT max(l) AS l, max(filled) AS filled FROM l, b WHERE filled <= b)
SELECT class_id, size, least(size, l) + CASE WHEN size > l AND row_number() OVER (PARTITION BY size > l ORDER BY class_id) <= b - filled THEN 1 ELSE 0 END AS share FROM z, m, b""")
def fair_class_shares(spark, d):
    """60 % of the documents dealt to their sources, one of which is hot."""
    sizes = cut(table(spark, d, "documents").groupBy(F.col("source").alias("class_id")).agg(F.count(F.lit(1)).alias("size")))
    return balance.fair_shares(sizes, budget(0.6, sizes.agg(F.sum("size")).first()[0]))


@register("""WITH z AS (SELECT source, count(*) AS size FROM documents GROUP BY source), b AS (SELECT CAST(round_even(0.3::DOUBLE * sum(size), 0) AS BIGINT) AS b FROM z),
l AS (SELECT l, sum(least(size, l)) AS filled FROM z, range((SELECT max(size) + 1 FROM z)) t(l) GROUP BY l), m AS (SELECT max(l) AS l, max(filled) AS filled FROM l, b WHERE filled <= b),
q AS (SELECT source, least(size, l) + CASE WHEN size > l AND row_number() OVER (PARTITION BY size > l ORDER BY source) <= b - filled THEN 1 ELSE 0 END AS share FROM z, m, b),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS keep_rank FROM documents)
SELECT doc_id AS image_id, source AS class_id, keep_rank, share FROM r JOIN q USING (source) WHERE keep_rank <= share""")
def select_class_balanced(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("row_idx"), F.col("source").alias("class_id"))
    found = balance.class_balanced(rows, budget(0.3, rows.count()), 5)
    return found.where("selected").select("image_id", "class_id", "keep_rank", "share")


REGIONS = """cell AS (SELECT image_id, patch_idx, proto_id FROM pnear),
side AS (SELECT a.image_id, a.patch_idx AS a, b.patch_idx AS b FROM cell a JOIN cell b ON a.image_id = b.image_id AND a.proto_id = b.proto_id AND ((abs(a.patch_idx - b.patch_idx) = 4) OR (abs(a.patch_idx - b.patch_idx) = 1 AND a.patch_idx // 4 = b.patch_idx // 4))),
reach AS (SELECT image_id, patch_idx, patch_idx AS root FROM cell UNION SELECT r.image_id, s.b, r.root FROM reach r JOIN side s ON s.image_id = r.image_id AND s.a = r.patch_idx WHERE r.root < s.b),
parts AS (SELECT image_id, patch_idx, min(root) AS region FROM reach GROUP BY ALL),
regions AS (SELECT p.image_id, region, proto_id, count(*) AS pixels FROM parts p JOIN cell c ON c.image_id = p.image_id AND c.patch_idx = p.region GROUP BY ALL)"""


@register(f"WITH RECURSIVE {REGIONS} SELECT image_id, region, proto_id, pixels FROM regions", "patches")
def patch_regions(spark, d):
    return balance.regions(X.assigned_patches(spark, d), 4)


@register(f"""WITH RECURSIVE {REGIONS},
f AS (SELECT proto_id, pow(sum(pixels) / (SELECT CAST(sum(pixels) AS DOUBLE) FROM regions), -1.0) AS w FROM regions GROUP BY proto_id),
o AS (SELECT *, sum(pixels) OVER (PARTITION BY proto_id ORDER BY pixels, image_id, region ROWS UNBOUNDED PRECEDING) AS after FROM regions),
v AS (SELECT o.*, round(w * (sqrt(after::DOUBLE) - sqrt((after - pixels)::DOUBLE)) / pixels, 9) AS worth FROM o JOIN f USING (proto_id)),
t AS (SELECT *, sum(pixels) OVER (ORDER BY worth DESC, proto_id, pixels, image_id, region ROWS UNBOUNDED PRECEDING) AS taken FROM v)
SELECT image_id, region, proto_id, pixels, worth, CAST(taken AS BIGINT) AS taken FROM t WHERE taken <= (SELECT CAST(round_even(0.2::DOUBLE * sum(pixels), 0) AS BIGINT) FROM regions)""", "patches")
def select_regions(spark, d):
    """A fifth of all patches, by region."""
    found = cut(balance.regions(X.assigned_patches(spark, d), 4))
    chosen = balance.choose_regions(found, budget(0.2, found.agg(F.sum("pixels")).first()[0]))
    return chosen.where("selected").select("image_id", "region", "proto_id", "pixels", "worth", "taken")


@register("""WITH m AS (SELECT method, ratio, seed, avg(miou) AS m FROM runs GROUP BY ALL), x AS (SELECT a.method, round(a.m - b.m, 9) AS x FROM m a JOIN m b USING (ratio, seed) WHERE a.method NOT IN ('random', 'full') AND b.method = 'random'),
u AS (SELECT method, x, 2 * rank() OVER (PARTITION BY method ORDER BY abs(x)) + count(*) OVER (PARTITION BY method, abs(x)) - 1 AS r FROM x WHERE x <> 0),
s AS (SELECT method, count(*) AS n_used, coalesce(sum(r) FILTER (x > 0), 0) AS p, coalesce(sum(r) FILTER (x < 0), 0) AS q,
  list_reduce(list([r::DOUBLE] ORDER BY r), lambda h, r: list_transform(list_zip(list_concat(h, list_resize([]::DOUBLE[], r[1]::BIGINT, 0.0)), list_concat(list_resize([]::DOUBLE[], r[1]::BIGINT, 0.0), h)), lambda z: (z[1] + z[2]) / 2), [1.0::DOUBLE]) AS c FROM u GROUP BY method)
SELECT method, (SELECT count(*) FROM x WHERE x.method = s.method) AS n_pairs, n_used, p / 2.0 AS w_plus, q / 2.0 AS w_minus, round(least(1.0, 2 * list_sum(c[1:least(p, q)::BIGINT + 1])), 9) AS p_value FROM s""", "runs")
def wilcoxon_methods(spark, d):
    return stats.signed_ranks(stats.paired(X.runs(spark, d)))


AUC = """WITH c AS (SELECT method, ratio, avg(miou) AS y FROM runs WHERE method <> 'full' AND NOT (method = 'high' AND ratio = 0.3) AND NOT (method = 'urgent' AND ratio = 0.5) GROUP BY ALL), b AS (SELECT 0.15::DOUBLE AS lo, 0.4::DOUBLE AS hi),
s AS (SELECT method, ratio AS x0, y AS y0, lead(ratio) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY method ORDER BY ratio)),
p AS (SELECT method, greatest(x0, lo) AS a, least(x1, hi) AS z, x0, y0, (y1 - y0) / (x1 - x0) AS k FROM s, b WHERE x1 IS NOT NULL AND x1 > lo AND x0 < hi),
t AS (SELECT method, sum((z - a) * ((y0 + k * (a - x0)) + (y0 + k * (z - x0))) / 2) AS s FROM p GROUP BY method)
SELECT c.method, count(*) AS n_ratios, any_value(lo) AS low, any_value(hi) AS high, CASE WHEN min(ratio) <= any_value(lo) AND max(ratio) >= any_value(hi) THEN round(any_value(s) / (any_value(hi) - any_value(lo)), 6) END AS auc FROM c JOIN t USING (method), b GROUP BY c.method"""


@register(AUC, "runs")
def auc_retention(spark, d):
    """Areas from 0.15 to 0.4 where one method lacks a ratio inside and another one the last."""
    runs = X.runs(spark, d).where("method <> 'full' AND NOT (method = 'high' AND ratio = 0.3) AND NOT (method = 'urgent' AND ratio = 0.5)")
    return stats.area(runs.select("method", "ratio", F.col("miou").alias("value")), low=0.15, high=0.4)


@register("""WITH pools AS (SELECT avg(miou) AS ref FROM runs WHERE method = 'full' AND ratio = 1.0), c AS (SELECT family, ratio, round(100 * avg(miou) / (SELECT ref FROM pools), 6) AS y FROM runs GROUP BY ALL),
h AS (SELECT family, min(ratio) AS first, max(ratio) AS last FROM c GROUP BY family), b AS (SELECT max(first) AS lo, min(last) AS hi FROM h),
s AS (SELECT family, ratio AS x0, y AS y0, lead(ratio) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY family ORDER BY ratio)),
p AS (SELECT family, greatest(x0, lo) AS a, least(x1, hi) AS z, x0, y0, (y1 - y0) / (x1 - x0) AS k FROM s, b WHERE x1 IS NOT NULL AND x1 > lo AND x0 < hi),
t AS (SELECT family, sum((z - a) * ((y0 + k * (a - x0)) + (y0 + k * (z - x0))) / 2) AS s FROM p GROUP BY family)
SELECT c.family, count(*) AS n_ratios, any_value(lo) AS low, any_value(hi) AS high, round(any_value(s) / (any_value(hi) - any_value(lo)), 6) AS auc FROM c JOIN t USING (family), b GROUP BY c.family""", "runs")
def auc_retention_families(spark, d):
    """Areas under retention over the ratios that all families cover."""
    curves = report.retention(X.runs(spark, d)).select("family", "ratio", F.col("retention_pct").alias("value"))
    return stats.area(curves, "family")
