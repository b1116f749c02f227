"""k-means++ seeding over all rows."""

import numpy as np
import pytest

from tessella.operators import cluster, diagnostics, prune


def test_seeding_reaches_a_rare_cluster_at_any_partitioning(spark):
    rng = np.random.default_rng(1)
    axes = np.repeat(np.eye(4)[:3], [200, 200, 1], axis=0) + rng.normal(0, 0.005, (401, 4))
    points = axes / np.linalg.norm(axes, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "row_idx long, v array<double>")
    found = cluster.spread_seeds(rows, 3, [0, 1])
    assert np.array_equal(found, cluster.spread_seeds(rows.repartition(7), 3, [0, 1]))
    for seeds in found:
        assert all((seeds @ axis).max() > 0.95 for axis in np.eye(4)[:3])
    fit = cluster.fit(rows, 3, restarts=1)
    assert (fit.centroids @ points[400]).max() > 0.99


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(8)
    points = np.repeat(rng.normal(size=(5, 6)), 30, axis=0) + rng.normal(0, 0.3, (150, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    return points, spark.createDataFrame([(f"i{i:03d}", i, p.tolist()) for i, p in enumerate(points)], "image_id string, row_idx long, v array<double>").repartition(3).cache()


def plain_silhouette(points, label):
    out = []
    for i, p in enumerate(points):
        mean = {c: 1 - np.delete(points[label == c] @ p, np.flatnonzero(np.flatnonzero(label == c) == i)).mean() for c in set(label) if (label == c).sum() > (c == label[i])}
        if label[i] not in mean:
            out.append(0.0)
            continue
        a, b = mean.pop(label[i]), min(mean.values())
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_fits_together_are_the_fits_alone_and_scores_equal_numpy(spark, blobs):
    points, rows = blobs
    jobs = [(2, 0), (5, 0), (5, 1), (9, 1)]
    fits = cluster.fit_all(rows, jobs, restarts=2)
    for job in jobs:
        # A pool of candidates grows with the largest k, so a fit alone may draw others; both rest at means of their members.
        label = (points @ fits[job].centroids.T).argmax(axis=1)
        means = np.stack([points[label == c].sum(axis=0) for c in range(job[0])])
        assert fits[job].converged and np.allclose(means / np.linalg.norm(means, axis=1, keepdims=True), fits[job].centroids)
        assert fits[job].objective == pytest.approx((1 - (points @ fits[job].centroids.T).max(axis=1)).sum())
    again = cluster.fit_all(rows.repartition(5), jobs, restarts=2)
    assert all(np.allclose(again[j].centroids, fits[j].centroids) for j in jobs)
    scores = cluster.silhouettes(rows, [fits[j].centroids for j in jobs])
    for job, score in zip(jobs, scores, strict=True):
        assert score == pytest.approx(plain_silhouette(points, (points @ fits[job].centroids.T).argmax(axis=1)))
    assert cluster.silhouettes(rows, [fits[2, 0].centroids[:1]]) == [None]
    with pytest.raises(ValueError):
        cluster.fit_all(rows, [(151, 0)])


def test_diagnostics_equal_numpy_over_the_fits(spark, blobs):
    points, rows = blobs
    ks, seeds = (2, 4, 5), (0, 1)
    fits = cluster.fit_all(rows, [(k, s) for k in ks for s in seeds], 2)
    label = {j: (points @ f.centroids.T).argmax(axis=1) for j, f in fits.items()}
    found = {r.k: r for r in diagnostics.diagnose(rows, ks, seeds, 2).collect()}
    for n, k in enumerate(ks):
        scores, inertia = [plain_silhouette(points, label[k, s]) for s in seeds], [2 * fits[k, s].objective for s in seeds]
        assert (found[k].silhouette_mean, found[k].silhouette_std, found[k].inertia_mean, found[k].inertia_std) == pytest.approx((np.mean(scores), np.std(scores), np.mean(inertia), np.std(inertia)), abs=1e-9)
        if n:
            before = np.mean([2 * fits[ks[n - 1], s].objective for s in seeds])
            assert found[k].inertia_drop_pct == pytest.approx(100 * (before - np.mean(inertia)) / before, abs=1e-5)
    swept = {r.k: r for r in diagnostics.stability(rows, (2, 5), seeds, 30, 4, 2).collect()}
    fits = cluster.fit_all(rows, [(k, s) for k in (2, 5, 4) for s in seeds], 2)

    def run(k, s):
        c = fits[k, s].centroids
        frame = cluster.assigned(rows, cluster.as_prototypes(spark, c)).drop("v")
        picked = {r.image_id for r in prune.select_by_score(frame, 30).where("selected").collect()}
        return np.round(1 - (points @ c.T).max(axis=1), 9), picked, (points @ c.T).argmax(axis=1)

    def agree(x, y):
        rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        return np.corrcoef(rank(x[0]), rank(y[0]))[0, 1], len(x[1] & y[1]) / len(x[1] | y[1])

    for k in (2, 5):
        across, ref = agree(run(k, 0), run(k, 1)), [agree(run(k, s), run(4, s)) for s in seeds]
        got = swept[k]
        assert (got.spearman_across_seeds, got.jaccard_across_seeds) == pytest.approx(across, abs=1e-5)
        assert (got.spearman_vs_reference, got.jaccard_vs_reference) == pytest.approx(tuple(np.mean(ref, axis=0)), abs=1e-5)
        sizes = np.bincount(run(k, 0)[2], minlength=k)
        assert (got.min_cluster_size, got.median_cluster_size) == (sizes.min(), np.median(sizes))
