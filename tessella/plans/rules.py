"""Queries of the scalar rules, small aggregates and table sinks, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import diagnostics, metrics, report
from tessella.plans import fixtures as X
from tessella.plans.book import register
from tessella.sources import store
from tessella.sources.tables import table


@register(f"""WITH m AS (SELECT unnest([{', '.join(map(str, scalars.STREET_IDS))}]) AS raw, unnest(range({len(scalars.STREET_IDS)})) AS label)
SELECT CAST(r.raw AS INTEGER) AS raw, CAST(coalesce(m.label, 255) AS INTEGER) AS street, CAST(CASE WHEN r.raw = 0 THEN 255 ELSE r.raw - 1 END AS INTEGER) AS scene, CAST(CASE WHEN r.raw >= 11 THEN 255 ELSE r.raw END AS INTEGER) AS clamped
FROM (SELECT DISTINCT l_partkey % 256 AS raw FROM lineitem) r LEFT JOIN m ON m.raw = r.raw""")
def label_rules(spark, d):
    raw = F.col("raw")
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 256).cast("int").alias("raw")).distinct()
    return rows.select("raw", scalars.street_label(raw).alias("street"), scalars.scene_label(raw).alias("scene"), scalars.clamped_label(raw, 11).alias("clamped"))


@register("""WITH s AS (SELECT event_id, event_id % 1000 AS step, least(1.0, greatest(0.0, (event_id % 1000 - 100) / 900.0)) AS done FROM events)
SELECT event_id, round(CASE WHEN step < 100 THEN 6e-5 * (1e-6 + (1.0 - 1e-6) * step / 100.0) ELSE 6e-5 * (1.0 - done) END, 12) AS poly,
  round(CASE WHEN step < 100 THEN 6e-5 * (1e-6 + (1.0 - 1e-6) * step / 100.0) ELSE 6e-5 * 0.5 * (1.0 + cos(pi() * done)) END, 12) AS cosine, round(CASE WHEN step < 100 THEN 6e-5 * (1e-6 + (1.0 - 1e-6) * step / 100.0) ELSE 6e-5 END, 12) AS constant FROM s""")
def learning_rates(spark, d):
    """The rate of each event, as a step of runs of 1,000 steps."""
    step = (F.col("event_id") % 1000).cast("int")
    return table(spark, d, "events").select("event_id", *[F.round(scalars.learning_rate(step, 6e-5, 1000, 100, kind), 12).alias(kind) for kind in ("poly", "cosine", "constant")])


@register("SELECT p_partkey, list_sort(list_distinct(list_concat(range(0, greatest(0, p - 512) + 1, 341), [greatest(0, p - 512)])))::VARCHAR AS origins FROM (SELECT p_partkey, CAST(300 + 37 * p_size AS BIGINT) AS p FROM part)")
def tile_origins(spark, d):
    sides = table(spark, d, "part").select("p_partkey", (300 + 37 * F.col("p_size")).cast("int").alias("side"))
    return sides.select("p_partkey", F.concat(F.lit("["), F.array_join(scalars.tile_origins(F.col("side"), 512, 341), ", "), F.lit("]")).alias("origins"))


@register("SELECT c_custkey, CASE WHEN length(t) <= 64 THEN t ELSE substr(t, 1, 55) || '-' || substr(sha1(t), 1, 8) END AS tag FROM (SELECT c_custkey, repeat(c_name || '-', CAST(c_custkey % 6 + 1 AS INTEGER)) AS t FROM customer)")
def fitted_tags(spark, d):
    tags = table(spark, d, "customer").select("c_custkey", F.expr("repeat(concat(c_name, '-'), CAST(c_custkey % 6 + 1 AS INT))").alias("t"))
    return tags.select("c_custkey", scalars.fit_tag(F.col("t")).alias("tag"))


@register("SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-8 + 1e-5 * abs(0.05)")
def close_ratios(spark, d):
    return table(spark, d, "lineitem").where(scalars.is_close(F.col("l_discount"), 0.05)).select("l_orderkey", "l_partkey", "l_discount")


@register("SELECT CAST(event_id // 50 AS BIGINT) AS block, count(*) AS steps, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def tumbling_loss(spark, d):
    return report.tumbling_mean(table(spark, d, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss")), 50)


@register("SELECT 1 + coalesce(max(CAST(regexp_extract(o_comment_no, 'Experiment (\\d+)', 1) AS BIGINT)), 0) AS next FROM (SELECT 'Experiment ' || (o_orderkey % 977) || ' done' AS o_comment_no FROM orders)")
def next_number(spark, d):
    return report.next_number(table(spark, d, "orders").select(F.concat(F.lit("Experiment "), (F.col("o_orderkey") % 977).cast("string"), F.lit(" done")).alias("text")))


@register("""WITH s AS (SELECT CAST(p_size AS INTEGER) AS k, CASE WHEN p_size % 3 = 0 THEN 'nan'::DOUBLE ELSE round(avg(p_retailprice), 6) END AS silhouette FROM part GROUP BY p_size)
SELECT k AS best_k FROM s WHERE NOT isnan(silhouette) ORDER BY silhouette DESC, k LIMIT 1""")
def best_k(spark, d):
    means = table(spark, d, "part").groupBy(F.col("p_size").cast("int").alias("k")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"))
    sweep = means.select("k", F.when(F.col("k") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("mean")).alias("silhouette"))
    return diagnostics.best_k(sweep, "silhouette")


@register("""WITH h AS (SELECT image_id, proto_id, count(*) / CAST(sum(count(*)) OVER (PARTITION BY image_id) AS DOUBLE) AS share FROM pnear GROUP BY image_id, proto_id)
SELECT image_id, proto_id, CAST(round_even(share * 16, 0) AS BIGINT) AS n FROM h""", "patches")
def histogram_counts(spark, d):
    own = X.assigned_patches(spark, d).groupBy("image_id", "proto_id").agg(F.count(F.lit(1)).alias("c"))
    shares = own.select("image_id", "proto_id", (F.col("c") / F.lit(float(X.SLICES))).alias("share"))
    return diagnostics.counts_of(shares, X.SLICES)


@register("SELECT c AS class_id, count(p.target) AS n FROM (SELECT CAST(i AS INTEGER) AS c FROM range(12) t(i)) LEFT JOIN pixels p ON p.target = c GROUP BY c", "pixels")
def valid_class_counts(spark, d):
    return metrics.class_counts(X.pixels(spark, d), 12)


@register("SELECT round(avg(s) FILTER (NOT isnan(s)), 6) AS boundary_f FROM (SELECT CASE WHEN l_partkey % 7 = 0 THEN 'nan'::DOUBLE ELSE l_discount END AS s FROM lineitem)")
def boundary_f_mean(spark, d):
    scores = table(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("boundary_f"))
    return metrics.boundary_mean(scores)


@register("""WITH old AS (SELECT CAST(image_id AS VARCHAR) AS image_id, label AS v FROM emb WHERE label < 7), new AS (SELECT CAST(image_id AS VARCHAR) AS image_id, 100 + label AS v FROM emb WHERE label > 4)
SELECT image_id, CAST(v AS DOUBLE) AS v FROM new UNION ALL SELECT image_id, CAST(v AS DOUBLE) FROM old WHERE image_id NOT IN (SELECT image_id FROM new)""", "emb")
def store_upserted(spark, d):
    rows = X.emb(spark, d)
    one = {"dataset": "street", "split": "train", "backbone": "b", "source": "derived", "method": "cls"}
    made = lambda part, value: store.derivation(part.select("image_id", F.array(value.cast("float")).alias("embedding")), **one)
    both = store.upserted(made(rows.where("label < 7"), F.col("label")), made(rows.where("label > 4"), F.col("label") + 100))
    return both.select("image_id", F.col("embedding")[0].cast("double").alias("v"))
