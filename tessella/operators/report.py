"""Run-ledger reports: references, baseline bands, method matrices and family summaries.

Runs are (id, name, url, created_at, family, dataset, model, method, ratio, seed, lr, epochs, recipe, steps, miou,
rare_miou, pixel_acc, boundary_f, runtime_h).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.plans.lineage import ranked

REF_KEY = ("dataset", "model", "recipe", "lr", "epochs")
KEY = ("ratio", "lr", "epochs")


def r6(x: Column) -> Column:
    return F.round(x, 6)


def mean_std(value: str, name: str) -> list[Column]:
    """Mean and sample deviation of what is there; the deviation of one value is null."""
    return [r6(F.avg(value)).alias(f"{name}_mean"), r6(F.stddev_samp(value)).alias(f"{name}_std")]


def mean_std_text(mean: Column, std: Column, digits: int = 2, scale: float = 100.0) -> Column:
    number = lambda x: F.format_string(f"%.{digits}f", x * scale)
    return F.when(mean.isNull(), "–").when(std.isNull(), number(mean)).otherwise(F.concat_ws(" ± ", number(mean), number(std)))


def finished(api_runs: DataFrame) -> DataFrame:
    """Add skip_reason: the state of an unfinished run, or the missing metric; null for runs that count."""
    return api_runs.withColumn("skip_reason", F.when(F.col("state") != "finished", F.col("state")).when(F.col("miou").isNull(), "no final/miou in summary"))


def unreported(runs: DataFrame, text: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Runs whose id no link in the text holds, by name patterns (searched, not anchored)."""
    seen = runs.sparkSession.createDataFrame([(text,)], "t string").select(F.explode(F.regexp_extract_all("t", F.lit(r"/runs/([A-Za-z0-9]+)"), F.lit(1))).alias("id")).distinct()
    out = runs.join(seen, "id", "left_anti")
    out = out.where(F.col("name").rlike(include)) if include is not None else out
    return out.where(~F.col("name").rlike(exclude)) if exclude is not None else out


def latest_ledger(ledger: DataFrame, key: str = "wandb_run_id", place: str = "line") -> DataFrame:
    """The last row of each non-blank key."""
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(place)))
    return ledger.where(F.coalesce(F.trim(key), F.lit("")) != "").withColumn("__n", last).where("__n = 1").drop("__n")


def with_ledger(runs: DataFrame, ledger: DataFrame, columns: dict[str, str], key: str = "wandb_run_id") -> DataFrame:
    """Runs with columns (name: ledger column) of the last ledger row of their id; null where there is none."""
    last = latest_ledger(ledger, key).select(F.col(key).alias("id"), *[F.col(c).alias(n) for n, c in columns.items()])
    return runs.join(last, "id", "left")


def next_number(reports: DataFrame, pattern: str = r"Experiment (\d+)") -> DataFrame:
    """One row, `next`: one more than the largest number that the pattern finds in the texts; 1 where it finds none."""
    found = reports.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("n"))
    return found.agg((F.coalesce(F.max(F.col("n").cast("long")), F.lit(0)) + 1).alias("next"))


def tumbling_mean(steps: DataFrame, every: int) -> DataFrame:
    """(block, steps, loss) of (step, loss), steps from 1: the mean of each `every` of them."""
    return steps.groupBy(F.floor((F.col("step") - 1) / every).alias("block")).agg(F.count(F.lit(1)).alias("steps"), r6(F.avg("loss")).alias("loss"))


def grouped_means(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each group's rows, and the mean and sample deviation of its values."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[e for v in values for e in mean_std(v, v)])


def references(runs: DataFrame) -> DataFrame:
    """(family, REF_KEY..., ref_family, ref_miou): the full-data runs that a family's retention is measured by.

    A family's own full runs come first, else those of the family with the most of them, the latest on ties.
    """
    full = runs.where((F.col("method") == "full") & (F.col("ratio") == 1.0))
    pools = full.groupBy(*REF_KEY, F.col("family").alias("ref_family")).agg(F.avg("miou").alias("ref_miou"), F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest"))
    wanted = runs.select("family", *REF_KEY).distinct()
    best = W.partitionBy("family", *REF_KEY).orderBy(F.desc(F.col("family") == F.col("ref_family")), F.desc("n"), F.desc("latest"), "ref_family")
    return wanted.join(pools, list(REF_KEY)).withColumn("__n", F.row_number().over(best)).where("__n = 1").select("family", *REF_KEY, "ref_family", "ref_miou")


def retention(runs: DataFrame) -> DataFrame:
    """Mean miou of each family and key over its reference's, in percent; null without a reference."""
    rows = runs.groupBy("family", *KEY, "dataset", "model", "recipe").agg(F.avg("miou").alias("m"), F.count(F.lit(1)).alias("n_runs"))
    out = rows.join(references(runs), ["family", *REF_KEY], "left")
    return out.select("family", *KEY, "n_runs", "ref_family", r6(100 * F.col("m") / F.col("ref_miou")).alias("retention_pct"))


def verdict(mean: Column, base: Column, std: Column) -> Column:
    """Place of a mean against the baseline's band; strict on both sides, null without a deviation."""
    return F.when(std.isNull(), None).when(mean > base + std, "above band").when(mean < base - std, "below band").otherwise("inside band")


def band_table(runs: DataFrame, baseline: str = "random") -> DataFrame:
    """Each method and key against the baseline family with the most runs of the same ratio and reference key, the latest on ties."""
    match = ["ratio", *REF_KEY]
    pools = runs.where(F.col("method") == baseline).groupBy(*match, F.col("family").alias("base_family")).agg(
        F.count(F.lit(1)).alias("n_base"), F.max("created_at").alias("latest"), *[f(c).alias(f"{n}_{c}") for c in ("miou", "rare_miou") for f, n in ((F.avg, "base"), (F.stddev_samp, "sd"))]
    )
    best = W.partitionBy(*match).orderBy(F.desc("n_base"), F.desc("latest"), "base_family")
    base = pools.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "latest")
    own = runs.where(~F.col("method").isin(baseline, "full")).groupBy("family", "method", *match).agg(F.avg("miou").alias("miou"), F.avg("rare_miou").alias("rare_miou"))
    out = own.join(base, match)
    return out.select(
        "family", "method", "ratio", "base_family", "n_base",
        *[e for c in ("miou", "rare_miou") for e in (r6(100 * (F.col(c) - F.col(f"base_{c}"))).alias(f"delta_{c}"), verdict(F.col(c), F.col(f"base_{c}"), F.col(f"sd_{c}")).alias(f"verdict_{c}"))],
    )


def base_family(runs: DataFrame, baseline: str = "random") -> DataFrame:
    """(dataset, model, base_family): the baseline family of the most runs, the latest on ties."""
    pools = runs.where(F.col("method") == baseline).groupBy("dataset", "model", F.col("family").alias("base_family")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest"))
    best = W.partitionBy("dataset", "model").orderBy(F.desc("n"), F.desc("latest"), "base_family")
    return pools.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("dataset", "model", "base_family")


def deltas(runs: DataFrame, baseline: str = "random", metric: str = "miou") -> DataFrame:
    """(dataset, model, method, ratio, delta, mark, n): methods against the base family's runs of the same ratio and reference keys.

    mark is 1 above the band, -1 below, 0 inside it or where the deviation is 0 or unknown.
    """
    chosen = base_family(runs, baseline)
    base = runs.join(F.broadcast(chosen), ["dataset", "model"]).where((F.col("method") == baseline) & (F.col("family") == F.col("base_family")))
    own = runs.where(~F.col("method").isin(baseline, "full"))
    keys = own.select("method", "ratio", *REF_KEY).distinct()
    met = keys.join(base.select("ratio", *REF_KEY, F.col(metric).alias("b"), F.col("id").alias("base_id")), ["ratio", *REF_KEY]).where("b IS NOT NULL")
    bands = met.groupBy("dataset", "model", "method", "ratio").agg(F.avg("b").alias("bm"), F.coalesce(F.stddev_samp("b"), F.lit(0.0)).alias("sd"))
    means = own.where(F.col(metric).isNotNull()).groupBy("dataset", "model", "method", "ratio").agg(F.avg(metric).alias("m"), F.count(F.lit(1)).alias("n"))
    d = F.col("m") - F.col("bm")
    mark = F.when((F.round("sd", 12) > 0) & (d > F.col("sd")), 1).when((F.round("sd", 12) > 0) & (d < -F.col("sd")), -1).otherwise(0)
    return means.join(bands, ["dataset", "model", "method", "ratio"]).select("dataset", "model", "method", "ratio", r6(100 * d).alias("delta"), mark.alias("mark"), "n")


def matrix(runs: DataFrame, ratios: list[float], baseline: str = "random", metric: str = "miou") -> DataFrame:
    """One row a method: the delta at each ratio, wins, losses, tested ratios and the mean delta."""
    rows = deltas(runs, baseline, metric)
    at = [F.max(F.when(F.col("ratio") == r, F.col("delta"))).alias(f"delta_r{round(100 * r):03d}") for r in ratios]
    return rows.groupBy("dataset", "model", "method").agg(*at, F.count_if(F.col("mark") == 1).alias("wins"), F.count_if(F.col("mark") == -1).alias("losses"), F.count(F.lit(1)).alias("tested"), r6(F.avg("delta")).alias("mean_delta"))


def per_class(ledger: DataFrame, baseline: str = "random") -> DataFrame:
    """(method, class_id, iou, delta) of (method, per_class_iou_json): mean IoU by class and its distance from the baseline's."""
    each = ledger.where("per_class_iou_json IS NOT NULL").select("method", F.explode(F.from_json("per_class_iou_json", "map<string,double>")).alias("c", "iou"))
    means = each.groupBy("method", F.col("c").cast("int").alias("class_id")).agg(F.avg("iou").alias("iou"))
    base = means.where(F.col("method") == baseline).select("class_id", F.col("iou").alias("base"))
    return means.join(F.broadcast(base), "class_id", "left").select("method", "class_id", r6(F.col("iou")).alias("iou"), r6(F.col("iou") - F.col("base")).alias("delta"))


def movers(classes: DataFrame, rare: list[int], least: float = 0.02) -> DataFrame:
    """Classes that are not rare and move by `least` for some method."""
    return classes.where(~F.col("class_id").isin(rare)).groupBy("class_id").agg(F.max(F.abs("delta")).alias("most")).where(F.col("most") >= least)


def families(runs: DataFrame) -> DataFrame:
    """One row a family and key: seeds, steps and image counts, metric means and deviations, and whether a seed repeats."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), " / ")
    return runs.groupBy("family", *KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("seed")), lambda s: s.cast("string")), ",").alias("seeds"), listed("steps").alias("steps"), listed("n_images").alias("n_images"), F.count(F.lit(1)).alias("n_runs"),
        (F.count_distinct("seed") < F.count(F.lit(1))).alias("repeated_seed"), *mean_std("miou", "miou"), *mean_std("rare_miou", "rare"),
    )


def first_seen(runs: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, values): a field's distinct values in the order in which they first come."""
    first = runs.groupBy(group, F.col(value).cast("string").alias("v")).agg(F.min(order).alias("o"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda e: e["v"]), " / ").alias("values"))


def in_order(runs: DataFrame) -> DataFrame:
    """Add place: runs by falling ratio, lr, epochs, seed (missing first) and time."""
    return ranked(runs, [F.desc("ratio"), F.asc("lr"), F.asc("epochs"), F.coalesce("seed", F.lit(-1)), F.asc("created_at"), F.asc("id")], "place")


def sections(runs: DataFrame) -> DataFrame:
    """(family, first_run, section): families by their first run."""
    first = runs.groupBy("family").agg(F.min("created_at").alias("first_run"))
    return ranked(first, [F.asc("first_run"), F.asc("family")], "section")
