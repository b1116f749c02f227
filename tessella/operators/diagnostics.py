"""Selection diagnostics: cluster tables, stability, sweeps, coverage and elbows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.vectors import PLACES
from tessella.operators import cluster, prune, scoring
from tessella.plans.lineage import cut, ranked


def cluster_sizes(scores: DataFrame, k: int) -> DataFrame:
    """(cluster, size) with empty clusters."""
    ids = scores.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return ids.join(scores.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"))


def clusters_frame(selected: DataFrame, k: int) -> DataFrame:
    """Size, distances, selected rows and quota of each cluster; empty ones hold zeros."""
    own = selected.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("distance"), PLACES).alias("dist_mean"), F.min("distance").alias("dist_min"), F.max("distance").alias("dist_max"),
        F.count_if("selected").alias("n_selected"), F.max("quota").alias("quota"),
    )
    ids = selected.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return ids.join(own, "cluster", "left").fillna(0)


def summary(selected: DataFrame, k: int) -> DataFrame:
    """One row: totals, least, median and largest cluster size and distance, slots by quota, clusters without a kept row."""
    sizes = clusters_frame(selected, k).agg(
        F.min("size").alias("size_min"), F.percentile("size", F.lit(0.5)).alias("size_median"), F.max("size").alias("size_max"),
        F.sum("quota").alias("n_from_quota"), F.count_if(F.col("n_selected") == 0).alias("clusters_without_kept"),
    )
    rows = selected.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("selected").alias("n_selected"), F.min("distance").alias("distance_min"),
        F.round(F.percentile("distance", F.lit(0.5)), PLACES).alias("distance_median"), F.max("distance").alias("distance_max"),
        F.min(F.when(F.col("selected"), F.col("distance"))).alias("selected_min"), F.max(F.when(F.col("selected"), F.col("distance"))).alias("selected_max"),
        F.round(2 * F.sum("distance"), 6).alias("inertia"),
    )
    return rows.crossJoin(F.broadcast(sizes))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row, `spearman`: the correlation of average ranks."""
    rows = cut(rows.select(F.col(a).alias("__x"), F.col(b).alias("__y")))
    n = rows.count()
    both = scoring.percentile(scoring.percentile(rows, "__x", "__a", n), "__y", "__b", n)
    return both.agg(F.round(F.corr("__a", "__b"), 6).alias("spearman"))


def jaccard(subsets: DataFrame, name: str = "name", item: str = "image_id") -> DataFrame:
    """(a, b, jaccard) of every pair a < b of subset names: shared over joined items, 0 for two empty ones.

    Pairs come from the shared items, so their number follows the overlaps; names without overlap are filled in.
    """
    rows = subsets.select(F.col(name).alias("n"), F.col(item).alias("i")).distinct()
    sizes = rows.groupBy("n").agg(F.count("i").alias("size"))
    shared = rows.alias("x").join(rows.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.n") < F.col("y.n"))).groupBy(F.col("x.n").alias("a"), F.col("y.n").alias("b")).agg(F.count(F.lit(1)).alias("both"))
    left, right = sizes.select(F.col("n").alias("a"), F.col("size").alias("na")), sizes.select(F.col("n").alias("b"), F.col("size").alias("nb"))
    pairs = left.join(right, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return pairs.select("a", "b", F.round(F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("na") + F.col("nb") - F.col("both")), F.lit(0.0)), PLACES).alias("jaccard"))


def rarest(totals: DataFrame, key: str, total: str, fraction: float) -> DataFrame:
    """The rarest keys with a total above 0, by (total, key): the first greatest(1, round half to even (fraction * n))."""
    kept = cut(totals.where(F.col(total) > 0))
    n = kept.count()
    return ranked(kept, [F.asc(total), F.asc(key)], "rank", n).where(F.col("rank") <= max(1, round(fraction * n)))


def coverage(subsets: DataFrame, counts: DataFrame, n_items: int, rare: DataFrame, least: int = 20) -> DataFrame:
    """Rare-concept coverage of subsets (name, image_id) over counts (image_id, proto_id, n): covered concepts, share and lift."""
    few = rare.select("proto_id")
    kept = counts.join(few, "proto_id")
    total, n_rare = kept.agg(F.sum("n")).first()[0], few.count()
    sizes = subsets.groupBy("name").agg(F.count(F.lit(1)).alias("n_images"))
    each = subsets.join(kept, "image_id").groupBy("name", "proto_id").agg(F.sum("n").alias("c"))
    out = each.groupBy("name").agg(F.count_if(F.col("c") >= least).alias("rare_covered"), F.sum("c").alias("c"))
    share = F.coalesce(F.col("c"), F.lit(0)) / F.lit(float(total or 1))
    return sizes.join(out, "name", "left").select(
        "name", "n_images", F.coalesce("rare_covered", F.lit(0)).alias("rare_covered"), F.lit(n_rare).cast("long").alias("n_rare"),
        F.round(share, PLACES).alias("rare_patch_share"), F.round(share / (F.col("n_images") / F.lit(float(n_items))), PLACES).alias("lift"),
    )


def inertia_drop(sweep: DataFrame) -> DataFrame:
    """Add the percent drop of inertia against the k before."""
    before = F.lag("inertia").over(W.orderBy("k"))
    return sweep.withColumn("inertia_drop_pct", F.round(-100.0 * F.try_divide(F.col("inertia") - before, before), 6))


def elbow(sweep: DataFrame) -> DataFrame:
    """One row, `elbow_k`: the k farthest from the chord of inertia over log k, the smallest on ties; null for a flat curve."""
    whole = W.orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x, y = F.ln(F.col("k").cast("double")), F.col("inertia")
    ends = sweep.select("k", x.alias("x"), y.alias("y"), *[f(c).over(whole).alias(n) for f, c, n in ((F.first, x, "x0"), (F.last, x, "x1"), (F.first, y, "y0"), (F.last, y, "y1"))])
    a, b = F.try_divide(F.col("x") - F.col("x0"), F.col("x1") - F.col("x0")), F.try_divide(F.col("y") - F.col("y1"), F.col("y0") - F.col("y1"))
    gap = ends.select("k", F.round(F.abs(1.0 - a - b), PLACES).alias("gap"))
    return gap.agg(F.min(F.when(F.col("gap").isNotNull(), F.struct((-F.col("gap")).alias("g"), "k"))).alias("m")).select(F.col("m.k").alias("elbow_k"))


def vocabulary_health(patches: DataFrame, k: int, tiny: float = 0.1) -> DataFrame:
    """One row of (proto_id, distance) patches: least, median and largest prototype, those under `tiny` of the mean size, and the mean distance."""
    sizes = cluster_sizes(patches.withColumnRenamed("proto_id", "cluster"), k).withColumn("mean", F.avg("size").over(W.partitionBy()))  # k rows
    out = sizes.agg(F.min("size").alias("min_size"), F.percentile("size", F.lit(0.5)).alias("median_size"), F.max("size").alias("max_size"), F.count_if(F.col("size") < tiny * F.col("mean")).alias("n_tiny"))
    return out.crossJoin(F.broadcast(patches.agg(F.round(F.avg("distance"), 6).alias("mean_distance"))))


def ends(rows: DataFrame, n: int) -> DataFrame:
    """(side, ...) of the n rows of least distance (most prototypical) and the n of largest; ties by image_id."""
    most, least = rows.orderBy("distance", "image_id").limit(n), rows.orderBy(F.desc("distance"), "image_id").limit(n)
    return most.select(F.lit("most").alias("side"), "*").unionByName(least.select(F.lit("least").alias("side"), "*"))


def best_k(sweep: DataFrame, score: str) -> DataFrame:
    """One row, `best_k`: the k of the highest score that is a number, the smallest on ties; null if none is."""
    kept = sweep.where(F.col(score).isNotNull() & ~F.isnan(score))
    return kept.agg(F.max(F.struct(F.col(score), (-F.col("k")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("best_k"))


def counts_of(histogram: DataFrame, patches: int) -> DataFrame:
    """(image_id, proto_id, n) of (image_id, proto_id, share): shares of an image's patches as whole counts, half to even."""
    return histogram.select("image_id", "proto_id", F.rint(F.col("share") * patches).cast("long").alias("n"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, `spearman`: how two vocabularies' scores (image_id, score) rank the images that both hold."""
    both = a.select("image_id", F.col("score").alias("a")).join(b.select("image_id", F.col("score").alias("b")), "image_id")
    return spearman(both, "a", "b")


def sensitivity(base: DataFrame, others: dict[str, DataFrame], budgets: Iterable[int]) -> DataFrame:
    """(name, spearman, jaccard) of other vocabularies' scores (image_id, score) against the base's: rank agreement, and the mean Jaccard index of both's highest rows over the budgets."""
    budgets, out = list(budgets), None
    top = lambda rows: cut(ranked(rows.select("image_id", "score"), [F.desc("score"), F.asc("image_id")], "place"))
    a = top(base).select("image_id", F.col("score").alias("a"), F.col("place").alias("p"))
    for name, rows in others.items():
        both = a.join(top(rows).select("image_id", F.col("score").alias("b"), F.col("place").alias("q")), "image_id", "full_outer")
        own = [F.try_divide(F.count_if((F.col("p") <= n) & (F.col("q") <= n)), F.count_if((F.col("p") <= n) | (F.col("q") <= n))) for n in budgets]
        mean = sum(own[1:], own[0]) / len(own)
        one = spearman(both.where("a IS NOT NULL AND b IS NOT NULL"), "a", "b").crossJoin(both.agg(F.round(mean, PLACES).alias("jaccard"))).select(F.lit(name).alias("name"), "spearman", "jaccard")
        out = one if out is None else out.unionByName(one)
    return out


def diagnose(rows: DataFrame, ks: Iterable[int], seeds: Iterable[int], restarts: int = 10) -> DataFrame:
    """Silhouette and inertia of fitted clusters over (k, seed): means, population deviations and the drop of inertia."""
    seeds = list(seeds)
    jobs = [(k, seed) for k in ks for seed in seeds]
    fits = cluster.fit_all(rows, jobs, restarts)
    scores = cluster.silhouettes(rows, [fits[j].centroids for j in jobs])
    found = [(*job, score, 2.0 * fits[job].objective) for job, score in zip(jobs, scores, strict=True)]
    table = rows.sparkSession.createDataFrame(found, "k int, seed int, silhouette double, inertia double")
    means = table.groupBy("k").agg(F.avg("silhouette").alias("silhouette_mean"), F.stddev_pop("silhouette").alias("silhouette_std"), F.avg("inertia").alias("inertia"), F.stddev_pop("inertia").alias("inertia_std"))
    return inertia_drop(means).withColumnRenamed("inertia", "inertia_mean")


def stability(rows: DataFrame, ks: Iterable[int], seeds: Iterable[int], budget: int, reference: int, restarts: int = 10) -> DataFrame:
    """k-sweep: cluster sizes, and how distances and selections agree across seeds and with the reference k."""
    spark: SparkSession = rows.sparkSession
    ks, seeds = list(ks), list(seeds)
    jobs = [(k, seed) for k in dict.fromkeys([*ks, reference]) for seed in seeds]
    fits = cluster.fit_all(rows, jobs, restarts)
    # One table holds every run's clusters and distances, and one its ranks: a row each for an image and run.
    found = cluster.placed(rows.select("row_idx", "v"), [fits[j].centroids for j in jobs])
    each = F.posexplode(F.arrays_zip("clusters", "distances")).alias("run", "e")
    runs = cut(found.select("row_idx", each).select("run", "row_idx", F.col("e.clusters").alias("cluster"), F.col("e.distances").alias("distance")))
    n = runs.where("run = 0").count()
    chosen = cut(prune.select_by_scores(runs, "run", budget, n))
    pairs = [((k, a), (k, b)) for k in ks for i, a in enumerate(seeds) for b in seeds[i + 1 :]] + [((k, s), (reference, s)) for k in ks for s in seeds]
    # A row of all runs' mean ranks and picks an image: correlations and overlaps of all pairs are sums over these rows.
    packed = F.array_sort(F.collect_list(F.struct("run", "rank", "selected"))).alias("r")
    wide = chosen.groupBy("row_idx").agg(packed)
    at = lambda job: F.col("r")[jobs.index(job)]
    both = [c for a, b in pairs for c in (F.round(F.corr(at(a)["rank"], at(b)["rank"]), 6), F.count_if(at(a)["selected"] & at(b)["selected"]), F.count_if(at(a)["selected"] | at(b)["selected"]))]
    told = wide.agg(*[c.alias(f"c{i}") for i, c in enumerate(both)]).first()
    agree = {pair: (float(told[3 * i] or 0.0), float(told[3 * i + 1] / told[3 * i + 2]) if told[3 * i + 2] else 0.0) for i, pair in enumerate(pairs)}
    counted = {(r.run, r.cluster): r.n for r in runs.groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    mean = lambda v, j: sum(x[j] for x in v) / len(v) if v else None
    out = []
    for k in ks:
        sizes = sorted(counted.get((jobs.index((k, seeds[0])), c), 0) for c in range(k))
        across = [agree[(k, a), (k, b)] for i, a in enumerate(seeds) for b in seeds[i + 1 :]]
        refs = [agree[(k, s), (reference, s)] for s in seeds]
        out.append((k, sizes[0], (sizes[(k - 1) // 2] + sizes[k // 2]) / 2.0, mean(across, 0), mean(across, 1), mean(refs, 0), mean(refs, 1)))
    return spark.createDataFrame(out, "k int, min_cluster_size long, median_cluster_size double, spearman_across_seeds double, jaccard_across_seeds double, spearman_vs_reference double, jaccard_vs_reference double")


def tail_checks(scores: DataFrame, patch_scores: DataFrame, qs: Iterable[float], ratios: Iterable[float]) -> DataFrame:
    """Over q and ratio: how the tail score agrees with the centroid distance, and its selection with that one's."""
    n, out = scores.count(), []
    for q in qs:
        tails = patch_scores.select("image_id", scoring.tail_mean("distances", q).alias("tail"))
        both = scores.join(tails, "image_id").persist()
        rank = spearman(both, "tail", "distance").first()[0]
        for ratio in ratios:
            b = round(ratio * n)
            one = prune.select_by_score(both.drop("tail"), b).where("selected").select("image_id")
            two = prune.select_by_score(both.drop("distance").withColumnRenamed("tail", "distance"), b).where("selected").select("image_id")
            same = one.intersect(two).count()
            out.append((q, ratio, float(rank or 0.0), same / (2 * b - same) if b else 0.0))
        both.unpersist()
    return scores.sparkSession.createDataFrame(out, "q double, ratio double, spearman_tail_vs_centroid double, jaccard_vs_centroid_subset double")
