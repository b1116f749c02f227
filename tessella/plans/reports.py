"""Queries over runs and the run ledger, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import report
from tessella.plans import fixtures as X
from tessella.plans.book import register
from tessella.sources.tables import table

RATIOS = [0.1, 0.2, 0.3, 0.5]
KEYS = "dataset, model, recipe, lr, epochs"


@register("SELECT id, name, method, ratio, seed, miou, rare_miou, steps, created_at, family FROM runs", "runs")
def report_runs(spark, d):
    return X.runs(spark, d).select("id", "name", "method", "ratio", "seed", "miou", "rare_miou", "steps", "created_at", "family")


STATES = "states AS (SELECT *, CASE CAST(substr(id, 2) AS BIGINT) % 5 WHEN 0 THEN 'crashed' WHEN 1 THEN 'running' ELSE 'finished' END AS state FROM runs)"


def states(spark, d) -> DataFrame:
    n = F.substring("id", 2, 20).cast("long") % 5
    return X.runs(spark, d).withColumn("state", F.when(n == 0, "crashed").when(n == 1, "running").otherwise("finished"))


@register(f"WITH {STATES} SELECT id, CASE WHEN state <> 'finished' THEN state WHEN rare_miou IS NULL THEN 'no final/miou in summary' END AS skip_reason FROM states", "runs")
def report_finished(spark, d):
    return report.finished(states(spark, d).drop("miou").withColumnRenamed("rare_miou", "miou")).select("id", "skip_reason")


@register("""WITH t AS (SELECT string_agg('see https://x.example/runs/' || id || ' ok', ' ') AS t FROM runs WHERE seed = 0)
SELECT id, name FROM runs WHERE regexp_matches(name, 'random|high') AND NOT regexp_matches(name, 'r0.5') AND NOT contains((SELECT t FROM t), '/runs/' || id || ' ')""", "runs")
def report_unreported(spark, d):
    runs = X.runs(spark, d)
    text = " ".join(f"see https://x.example/runs/{r[0]} ok" for r in runs.where("seed = 0").select("id").collect())
    return report.unreported(runs, text, "random|high", r"r0.5").select("id", "name")


@register(f"""WITH pools AS (SELECT {KEYS}, family AS ref_family, avg(miou) AS ref_miou, count(*) AS n, max(created_at) AS latest FROM runs WHERE method = 'full' AND ratio = 1.0 GROUP BY ALL),
refs AS (SELECT w.*, ref_family, ref_miou FROM (SELECT DISTINCT family, {KEYS} FROM runs) w JOIN pools USING ({KEYS})
  QUALIFY row_number() OVER (PARTITION BY family, {KEYS} ORDER BY (family = ref_family) DESC, n DESC, latest DESC, ref_family) = 1),
m AS (SELECT family, ratio, {KEYS}, avg(miou) AS m, count(*) AS n_runs FROM runs GROUP BY ALL)
SELECT family, ratio, lr, epochs, n_runs, ref_family, round(100 * m / ref_miou, 6) AS retention_pct FROM m LEFT JOIN refs USING (family, {KEYS})""", "runs")
def report_retention(spark, d):
    return report.retention(X.runs(spark, d))


@register(f"""WITH pools AS (SELECT ratio, {KEYS}, family AS base_family, count(*) AS n_base, max(created_at) AS latest, avg(miou) AS bm, stddev_samp(miou) AS sm, avg(rare_miou) AS br, stddev_samp(rare_miou) AS sr
  FROM runs WHERE method = 'random' GROUP BY ALL),
base AS (SELECT * FROM pools QUALIFY row_number() OVER (PARTITION BY ratio, {KEYS} ORDER BY n_base DESC, latest DESC, base_family) = 1),
own AS (SELECT family, method, ratio, {KEYS}, avg(miou) AS m, avg(rare_miou) AS r FROM runs WHERE method NOT IN ('random', 'full') GROUP BY ALL)
SELECT family, method, ratio, base_family, n_base, round(100 * (m - bm), 6) AS delta_miou, CASE WHEN sm IS NULL THEN NULL WHEN m > bm + sm THEN 'above band' WHEN m < bm - sm THEN 'below band' ELSE 'inside band' END AS verdict_miou,
  round(100 * (r - br), 6) AS delta_rare_miou, CASE WHEN sr IS NULL THEN NULL WHEN r > br + sr THEN 'above band' WHEN r < br - sr THEN 'below band' ELSE 'inside band' END AS verdict_rare_miou
FROM own JOIN base USING (ratio, {KEYS})""", "runs")
def report_bands(spark, d):
    return report.band_table(X.runs(spark, d))


DELTAS = f"""chosen AS (SELECT dataset, model, family AS base_family FROM runs WHERE method = 'random' GROUP BY dataset, model, family
  QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY count(*) DESC, max(created_at) DESC, family) = 1),
base AS (SELECT r.* FROM runs r JOIN chosen c ON r.dataset = c.dataset AND r.model = c.model AND r.family = c.base_family WHERE method = 'random'),
bands AS (SELECT k.dataset, k.model, k.method, k.ratio, avg(b.miou) AS bm, coalesce(stddev_samp(b.miou), 0.0) AS sd
  FROM (SELECT DISTINCT method, ratio, {KEYS} FROM runs WHERE method NOT IN ('random', 'full')) k JOIN base b ON {' AND '.join(f'k.{c} = b.{c}' for c in ('ratio', *KEYS.split(', ')))} GROUP BY ALL),
deltas AS (SELECT dataset, model, method, ratio, round(100 * (m - bm), 6) AS delta, CASE WHEN round(sd, 12) > 0 AND m - bm > sd THEN 1 WHEN round(sd, 12) > 0 AND m - bm < -sd THEN -1 ELSE 0 END AS mark, n
  FROM (SELECT dataset, model, method, ratio, avg(miou) AS m, count(*) AS n FROM runs WHERE method NOT IN ('random', 'full') GROUP BY ALL) JOIN bands USING (dataset, model, method, ratio))"""


@register(f"WITH {DELTAS} SELECT dataset, model, method, ratio, delta, mark, n FROM deltas", "runs")
def report_deltas(spark, d):
    return report.deltas(X.runs(spark, d))


@register(f"""WITH {DELTAS} SELECT dataset, model, method, {', '.join(f"max(delta) FILTER (ratio = {r}) AS delta_r{round(100 * r):03d}" for r in RATIOS)},
  count(*) FILTER (mark = 1) AS wins, count(*) FILTER (mark = -1) AS losses, count(*) AS tested, round(avg(delta), 6) AS mean_delta FROM deltas GROUP BY ALL""", "runs")
def report_matrix(spark, d):
    return report.matrix(X.runs(spark, d), RATIOS)


@register("""SELECT family, ratio, lr, epochs, array_to_string(list(seed ORDER BY seed), ',') AS seeds, array_to_string(list_sort(list(DISTINCT steps::VARCHAR)), ' / ') AS steps,
  array_to_string(list_sort(list(DISTINCT n_images::VARCHAR)), ' / ') AS n_images, count(*) AS n_runs, count(DISTINCT seed) < count(*) AS repeated_seed,
  round(avg(miou), 6) AS miou_mean, round(stddev_samp(miou), 6) AS miou_std, round(avg(rare_miou), 6) AS rare_mean, round(stddev_samp(rare_miou), 6) AS rare_std
FROM (SELECT *, CAST(round_even(ratio * 2975, 0) AS INTEGER) AS n_images FROM runs) GROUP BY family, ratio, lr, epochs""", "runs")
def report_families(spark, d):
    return report.families(X.runs(spark, d).withColumn("n_images", F.bround(F.col("ratio") * 2975).cast("int")))


@register("""SELECT family, round(100 * avg(miou), 2)::DECIMAL(12,2)::VARCHAR || CASE WHEN stddev_samp(miou) IS NULL THEN '' ELSE ' ± ' || round(100 * stddev_samp(miou), 2)::DECIMAL(12,2)::VARCHAR END AS miou FROM (SELECT family, round(miou, 3) AS miou FROM runs) GROUP BY family""", "runs")
def report_mean_std_text(spark, d):
    means = X.runs(spark, d).withColumn("miou", F.round("miou", 3)).groupBy("family").agg(F.avg("miou").alias("m"), F.stddev_samp("miou").alias("s"))
    return means.select("family", report.mean_std_text(F.col("m"), F.col("s")).alias("miou"))


@register("SELECT family, array_to_string(list(v ORDER BY o, v), ' / ') AS \"values\" FROM (SELECT family, ratio::VARCHAR AS v, min(created_at) AS o FROM runs GROUP BY ALL) GROUP BY family", "runs")
def report_first_seen(spark, d):
    return report.first_seen(X.runs(spark, d), "family", "ratio", "created_at")


@register("SELECT id, row_number() OVER (ORDER BY ratio DESC, lr, epochs, coalesce(seed, -1), created_at, id) AS place FROM runs", "runs")
def report_order(spark, d):
    return report.in_order(X.runs(spark, d)).select("id", "place")


@register("SELECT family, min(created_at) AS first_run, row_number() OVER (ORDER BY min(created_at), family) AS section FROM runs GROUP BY family", "runs")
def report_sections(spark, d):
    return report.sections(X.runs(spark, d))


CLASSES = """classes AS (SELECT 'm' || (l_suppkey % 4) AS method, l_partkey % 19 AS c, avg(l_discount) AS x FROM lineitem GROUP BY ALL),
means AS (SELECT method, CAST(c AS INTEGER) AS class_id, round(x * (1 + c / 10.0), 9) AS iou FROM classes),
pc AS (SELECT m.method, m.class_id, round(m.iou, 6) AS iou, round(m.iou - b.iou, 6) AS delta FROM means m LEFT JOIN means b ON b.method = 'm0' AND b.class_id = m.class_id)"""


def class_ledger(spark, d) -> DataFrame:
    """(method, per_class_iou_json): one row a method with its classes' values as JSON text."""
    cells = table(spark, d, "lineitem").groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("method"), (F.col("l_partkey") % 19).alias("c")).agg(F.avg("l_discount").alias("x"))
    iou = F.round(F.col("x") * (1 + F.col("c") / 10.0), 9)
    return cells.groupBy("method").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("string"), iou)))).alias("per_class_iou_json"))


@register(f"WITH {CLASSES} SELECT method, class_id, iou, delta FROM pc")
def report_per_class(spark, d):
    return report.per_class(class_ledger(spark, d), "m0")


@register(f"WITH {CLASSES} SELECT class_id, max(abs(delta)) AS most FROM pc WHERE class_id NOT IN (3, 4) GROUP BY class_id HAVING max(abs(delta)) >= 0.0005")
def report_movers(spark, d):
    return report.movers(report.per_class(class_ledger(spark, d), "m0"), [3, 4], 0.0005)


LEDGER = """led AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'x' || lpad((o_orderkey % 40 + 1)::VARCHAR, 9, '0') END AS wandb_run_id, o_totalprice AS miou FROM orders),
latest AS (SELECT * FROM led WHERE trim(coalesce(wandb_run_id, '')) <> '' QUALIFY row_number() OVER (PARTITION BY wandb_run_id ORDER BY line DESC) = 1)"""


def ledger(spark, d) -> DataFrame:
    from tessella.plans.lineage import ranked

    rows = ranked(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.asc("o_orderkey")], "n")
    key = F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.concat(F.lit("x"), F.lpad((F.col("o_orderkey") % 40 + 1).cast("string"), 9, "0")))
    return rows.select((F.col("n") - 1).alias("line"), key.alias("wandb_run_id"), F.col("o_totalprice").alias("miou"))


@register(f"WITH {LEDGER} SELECT wandb_run_id, line, miou FROM latest")
def ledger_latest(spark, d):
    return report.latest_ledger(ledger(spark, d)).select("wandb_run_id", "line", "miou")


@register(f"WITH {LEDGER} SELECT r.id, r.miou, round(l.miou, 6) AS ledger_miou, coalesce(CAST(l.line AS VARCHAR), '–') AS ledger_line FROM runs r LEFT JOIN latest l ON l.wandb_run_id = r.id", "runs")
def ledger_of_runs(spark, d):
    joined = report.with_ledger(X.runs(spark, d), ledger(spark, d), {"ledger_miou": "miou", "line": "line"})
    return joined.select("id", "miou", F.round("ledger_miou", 6).alias("ledger_miou"), F.coalesce(F.col("line").cast("string"), F.lit("–")).alias("ledger_line"))


@register("""WITH c AS (SELECT ratio, method AS name, seed, miou AS lift, rare_miou AS rare_patch_share FROM runs)
SELECT ratio, name, count(*) AS n, round(avg(lift), 6) AS lift_mean, round(stddev_samp(lift), 6) AS lift_std, round(avg(rare_patch_share), 6) AS rare_patch_share_mean, round(stddev_samp(rare_patch_share), 6) AS rare_patch_share_std FROM c GROUP BY ratio, name""", "runs")
def coverage_means(spark, d):
    rows = X.runs(spark, d).select("ratio", F.col("method").alias("name"), F.col("miou").alias("lift"), F.col("rare_miou").alias("rare_patch_share"))
    return report.grouped_means(rows, ["ratio", "name"], ["lift", "rare_patch_share"])
