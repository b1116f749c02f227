"""Paths that only larger tables take, and values that only they meet."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import vectors
from tessella.operators import cluster, scoring, semdedup, zcore
from tessella.plans.lineage import ranked


def test_ranks_beyond_one_task_take_any_name(spark):
    rows = spark.range(50).select(((F.col("id") * 7) % 50).alias("x"))
    for name in ("__at", "__part", "__before", "n"):
        assert {r.x: r[name] for r in ranked(rows, [F.asc("x")], name, one_task=10).collect()} == {x: x + 1 for x in range(50)}


def test_a_vector_is_scaled_in_time_linear_in_its_length(spark):
    # With a norm for each coordinate these 20 vectors took 20 * 6,000 ** 2 steps.
    rows = spark.range(20, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda x: x.cast("double")).alias("v"))
    run = lambda: [r.v for r in rows.select(vectors.unit("v").alias("v")).collect()]
    began = time.monotonic()
    found = run()
    assert time.monotonic() - began < 30
    assert np.allclose(found, np.arange(1, 6001) / np.linalg.norm(np.arange(1, 6001.0)))
    odd = spark.createDataFrame([([],), (None,), ([3.0, None],)], "v array<double>")
    assert [r.v for r in odd.select(vectors.unit("v").alias("v")).collect()] == [[], None, [None, None]]
    with pytest.raises(Exception, match="almost no norm"):
        odd.select(vectors.unit(F.array(F.lit(0.0))).alias("v")).collect()


def test_tail_means_that_end_in_a_half_round_as_in_sql(spark):
    rng = np.random.default_rng(0)
    rows = [(i, d.tolist()) for i, d in enumerate(np.round(rng.random((3000, 16)), 9))]
    frame = spark.createDataFrame(rows, "i long, d array<double>")
    found = dict(frame.select("i", scoring.tail_mean("d", 0.2)).collect())
    expected = duckdb.connect().execute("SELECT round(list_sum(list_sort(d, 'DESC')[1:4]) / 4, 9) FROM (SELECT unnest($1::DOUBLE[][]) AS d)", [[d for _, d in rows]]).fetchall()
    assert [found[i] for i in range(3000)] == [e for (e,) in expected]


def test_fits_deal_the_rows_of_one_task_over_the_cores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(900, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "row_idx long, v array<double>").coalesce(1)
    blocks = cluster.packed(rows, 900)
    assert blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(cluster, "SLICE", 4)
    fits = [points[:4], points[10:17]]
    sums, counts, total, _ = cluster.pass_over(blocks, fits)
    for f, s, c, t in zip(fits, sums, counts, total, strict=True):
        label = (points @ f.T).argmax(axis=1)
        assert np.allclose(s, [points[label == j].sum(axis=0) for j in range(len(f))]) and c.tolist() == np.bincount(label, minlength=len(f)).tolist()
        assert np.isclose(t, (points @ f.T).max(axis=1).sum())
    *_, far = cluster.pass_over(blocks, fits, spare=2)
    away = [np.sort((points @ f.T).max(axis=1))[:2] for f in fits]
    assert np.allclose([f[1] for f in far], np.concatenate(away)) and [f[0] for f in far] == [0, 0, 1, 1]
    found = {r.row_idx: r for r in cluster.placed(rows, fits).collect()}
    assert all(found[i].clusters == [int((f @ p).argmax()) for f in fits] for i, p in enumerate(points))


def test_least_values_of_lines_equal_a_whole_sort():
    rng = np.random.default_rng(2)
    away = np.round(rng.random((40, 90)), 1)
    away[3, 5:] = np.inf
    ids = rng.permutation(90)
    for most in (0, 1, 7, 90, 200):
        order = np.lexsort((np.broadcast_to(ids, away.shape), away), axis=1)[:, :most]
        expected = [(i, j, away[i, j]) for i in range(40) for j in order[i] if np.isfinite(away[i, j])]
        assert list(zip(*zcore.least(away, ids, most), strict=True)) == expected


def test_scores_deal_the_rows_of_one_task_over_the_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(zcore, "votes", lambda rows, *points, own=zcore.votes: seen.append(rows.rdd.getNumPartitions()) or own(rows, *points))
    rows = spark.createDataFrame([(i, i, [float(np.cos(i)), float(np.sin(i))]) for i in range(60)], "image_id long, row_idx long, v array<double>").coalesce(1)
    assert zcore.scores(rows, draws=20).count() == 60 and seen[0] >= spark.sparkContext.defaultParallelism


def test_blocks_that_are_one_group_meet_no_row_of_it(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(semdedup, "block_pairs", lambda rows, tau, own=semdedup.block_pairs: pairs.append(own(rows, tau)) or pairs[-1])
    x = np.linspace(0, 1.5, 300)
    rows = spark.createDataFrame([(i, 0, 0.0, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(x)], "row_idx long, cluster int, distance double, v array<double>")
    found = semdedup.duplicates(rows, 0.5, 20)
    assert pairs[0].count() > 50 and {r.component for r in found.collect()} == {0}
    # A chain that only far blocks close: the ends' rows are alike through no neighbour.
    far = spark.createDataFrame([(i, 0, 0.0, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate([0.0, 1.0, 2.0, 0.05, 1.05, 2.05, 3.0])], "row_idx long, cluster int, distance double, v array<double>")
    assert {r.row_idx: r.component for r in semdedup.duplicates(far, 0.99, 1).collect()} == {0: 0, 3: 0, 1: 1, 4: 1, 2: 2, 5: 2, 6: 6}
