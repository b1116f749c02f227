"""Coverage selectors against plain numpy on small tables."""

import hashlib
import math
import pickle

import numpy as np
import pytest

from tessella.operators import coverage, graph, greedy, kcenter, semdedup, submodular, zcore
from tessella.plans.lineage import cut


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, points, parts=3):
    return spark.createDataFrame([(f"i{n:03d}", n, p.tolist()) for n, p in enumerate(points)], "image_id string, row_idx long, v array<double>").repartition(parts)


def plain_greedy(gain_of, n, budget, k, mass):
    state, order = np.zeros(k), []
    for _ in range(budget):
        gains = np.round(np.array([gain_of(state, mass[i]) if i not in order else -np.inf for i in range(n)]), 9)
        order.append(int(gains.argmax()))
        state = state + mass[order[-1]]
    return order, state


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(3)
    mass = rng.random((120, 9)) * (rng.random((120, 9)) < 0.4)
    mass[7] = mass[8] = mass[9]
    mass[20] = 0
    rows = [(i, [int(j) for j in np.flatnonzero(m)], m[m > 0].tolist(), 0.0) for i, m in enumerate(mass)]
    return mass, spark.createDataFrame(rows, submodular.ROW)


def test_exact_greedy_equals_numpy_with_few_rows_a_pass(sparse, monkeypatch):
    mass, rows = sparse
    power = lambda s, m: ((s + m) ** 0.5 - s**0.5).sum()
    order, _ = plain_greedy(power, 120, 50, 9, mass)
    for top in (1, 7, 500):
        assert [i for i, _ in submodular.exact(rows, 50, submodular.Power(0.5), 9, top)] == order
    monkeypatch.setattr(submodular, "TOLD", 5)
    assert [i for i, _ in submodular.exact(rows, 50, submodular.Power(0.5), 9, 4)] == order
    assert greedy.greedy(rows.drop("bonus"), 50, 0.5, 9) == order


def test_rows_of_exact_greedy_hardly_reach_the_driver_twice(spark, monkeypatch):
    rng = np.random.default_rng(12)
    mass = rng.exponential(size=(1500, 6))
    mass[40:80] = mass[40]
    rows = spark.createDataFrame([(i, list(range(6)), m.tolist(), 0.0) for i, m in enumerate(mass)], submodular.ROW).repartition(3).cache()
    kind, sent = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    power = lambda s, m: ((s + m) ** 0.5 - s**0.5).sum()
    order, _ = plain_greedy(power, 1500, 300, 6, mass)
    monkeypatch.setattr(submodular, "WINDOW", 8)
    assert [i for i, _ in submodular.exact(rows, 300, submodular.Power(0.5), 6, 100)] == order
    assert sum(len(pickle.dumps(r)) for r in sent) < len(pickle.dumps(collect(rows)))
    # Rows that find no place on the driver go back, and come again.
    monkeypatch.setattr(submodular, "HELD", 800)
    assert [i for i, _ in submodular.exact(rows, 300, submodular.Power(0.5), 6, 100)] == order


@pytest.mark.parametrize("eps", [0.05, 0.3])
def test_threshold_passes_reach_the_factor_and_do_not_grow_with_the_budget(sparse, eps):
    mass, rows = sparse
    weights = np.linspace(1, 3, 9)
    objective = submodular.Survival(weights)
    value = lambda s: (weights * -np.expm1(-s)).sum()
    gain = lambda s, m: (weights * np.exp(-s) * -np.expm1(-m)).sum()
    passes = {}
    for budget in (5, 60):
        _, best = plain_greedy(gain, 120, budget, 9, mass)
        picked, passes[budget] = submodular.threshold(rows, budget, objective, 9, eps, top=1, parts=3)
        picked = sorted(picked.collect(), key=lambda r: r.keep_rank)
        assert [r.keep_rank for r in picked] == list(range(1, budget + 1)) and len({r.row_idx for r in picked}) == budget
        assert value(mass[[r.row_idx for r in picked]].sum(axis=0)) >= (1 - eps) * value(best)
        # Every pick gains at least (1 - eps) of the best row at its time.
        state = np.zeros(9)
        for n, r in enumerate(picked):
            left = [gain(state, mass[i]) for i in set(range(120)) - {x.row_idx for x in picked[:n]}]
            assert gain(state, mass[r.row_idx]) >= (1 - eps) * max(left) - 1e-8
            state = state + mass[r.row_idx]
    assert passes[60] <= 60


def test_threshold_fills_up_when_nothing_gains(spark):
    rows = spark.createDataFrame([(i, [0] if i < 2 else [], [40.0] if i < 2 else [], 0.0) for i in range(6)], submodular.ROW)
    picked, _ = submodular.threshold(rows, 5, submodular.Survival(np.array([1.0])), 1, 0.1, top=1)
    assert [r.row_idx for r in sorted(picked.collect(), key=lambda r: r.keep_rank)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        submodular.threshold(rows, 7, submodular.Power(1.0), 1)
    assert submodular.threshold(rows.where("false"), 0, submodular.Power(1.0), 1)[0].count() == 0


@pytest.mark.parametrize("saturation", [None, 4.0])
def test_patch_coverage_equals_numpy(spark, saturation):
    rng = np.random.default_rng(5)
    labels = [(i, int(p)) for i in range(40) for p in rng.choice(6, rng.integers(1, 12), p=[0.5, 0.3, 0.1, 0.05, 0.04, 0.01])] + [(40, 2)] * 5 + [(None, 1), (3, None)]
    patches = spark.createDataFrame(labels, "image_id long, proto_id int")
    items = spark.createDataFrame([(i, i) for i in range(42)], "image_id long, row_idx long")
    n = np.zeros((42, 6))
    for i, p in labels[:-2]:
        n[i, p] += 1
    freq = n.sum(axis=0) / n.sum()
    weights = np.where(freq > 0, np.maximum(freq, 1e-9) ** -0.7, 0.0)
    chance = 1 - np.exp(-n / saturation) if saturation else n / np.maximum(n.sum(axis=1, keepdims=True), 1)
    own = np.arange(42) / 100

    def value(s):
        return (weights * (1 - np.prod(1 - chance[s], axis=0))).sum() + 0.5 * own[s].sum()

    order = []
    for _ in range(10):
        order.append(max((i for i in range(42) if i not in order), key=lambda i: (round(value([*order, i]) - value(order), 8), -i)))
    bonus = spark.createDataFrame([(i, float(x)) for i, x in enumerate(own)], "image_id long, value double")
    options = {"saturation": saturation, "rarity": 0.7, "bonus": bonus, "strength": 0.5}
    found = coverage.choose(patches, items, 10, eps=None, **options).orderBy("keep_rank").collect()
    assert [r.row_idx for r in found] == order
    near = [r.row_idx for r in coverage.choose(patches, items, 10, eps=0.1, **options).collect()]
    assert value(near) >= 0.9 * value(order)
    counted = coverage.counts(patches)
    got = coverage.value(coverage.masses(counted, saturation), coverage.weights(counted, 0.7), items.where(f"image_id IN ({','.join(map(str, order))})")).first()
    assert abs(got.value - (value(order) - 0.5 * own[order].sum())) < 1e-5 and got.met == (n[order].sum(axis=0) > 0).sum()


def plain_centres(points, first, budget):
    order, gap = [first], np.full(len(points), np.inf)
    while len(order) < budget:
        gap = np.minimum(gap, kcenter.distance(points, points[order[-1:]])[:, 0])
        gap[order] = -1
        order.append(int(gap.argmax()))
    return order, float(np.minimum.reduce([kcenter.distance(points, points[[i]])[:, 0] for i in order]).max())


def test_kcentre_equals_plain_farthest_points(spark):
    rng = np.random.default_rng(1)
    points = unit(np.concatenate((rng.normal(size=(80, 5)), np.repeat(rng.normal(size=(2, 5)), 30, axis=0) + rng.normal(0, 1e-3, (60, 5)), np.repeat(rng.normal(size=(1, 5)), 20, axis=0))))
    rows = frame(spark, points)
    first = min(range(len(points)), key=lambda n: (hashlib.md5(f"4:i{n:03d}".encode()).hexdigest(), n))
    order, radius = plain_centres(points, first, 40)
    for top in (2, 9, 500):
        assert [i for i, _ in kcenter.centres(rows, 40, 4, top)] == order
    picked = kcenter.choose(rows, 40, 4)
    assert abs(kcenter.radius(rows, rows.join(picked, "row_idx")) - radius) < 1e-9
    # With more picks than distinct rows, repeats come last and once each.
    all_rows = [i for i, _ in kcenter.centres(rows, len(points), 4, 7)]
    assert sorted(all_rows) == list(range(len(points)))
    assert kcenter.centres(rows, 0) == []
    with pytest.raises(ValueError):
        kcenter.centres(rows, len(points) + 1)


@pytest.mark.parametrize("eps", [0.5, 2.0])
def test_composed_centres_keep_the_bound(spark, eps):
    rng = np.random.default_rng(7)
    points = unit(rng.normal(size=(12, 3)))[rng.integers(0, 12, 400)] + rng.normal(0, 0.02, (400, 3))
    points = unit(points)
    rows = frame(spark, points, 4)
    held = kcenter.composed(rows, 12, eps, block=60)
    assert held.count() < 400 and held.select("row_idx").distinct().count() == held.count()
    _, radius = plain_centres(points, 0, 12)
    got = kcenter.radius(rows, rows.join(kcenter.choose(rows, 12, 0, eps), "row_idx"))
    # The best radius is at least half of the greedy one.
    assert got <= (2 + eps) * radius + 1e-9
    assert kcenter.choose(rows, 400, 0, eps).count() == 400


def plain_groups(points, cluster, tau):
    group = list(range(len(points)))
    close = np.round(points @ points.T, 9) >= tau
    for i in range(len(points)):
        for j in range(i):
            if close[i, j] and cluster[i] == cluster[j] and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize(("tau", "size"), [(0.97, 16), (0.999, 7), (1.0, 1000)])
def test_duplicates_equal_all_pairs(spark, tau, size):
    rng = np.random.default_rng(9)
    points = unit(np.concatenate((rng.normal(size=(120, 4)), np.repeat(rng.normal(size=(3, 4)), 25, axis=0) + rng.normal(0, 0.02, (75, 4)), np.repeat(rng.normal(size=(1, 4)), 30, axis=0))))
    cluster = [int(p[0] > 0) if n % 50 else None for n, p in enumerate(points)]
    rows = spark.createDataFrame([(n, c, float(n % 7), p.tolist(), f"i{n}") for n, (p, c) in enumerate(zip(points, cluster, strict=True))], "row_idx long, cluster int, distance double, v array<double>, image_id string")
    expected = plain_groups(points, cluster, tau)
    assert {r.row_idx: r.component for r in semdedup.duplicates(rows, tau, size).collect()} == dict(enumerate(expected))
    kept = {r.row_idx for r in semdedup.keep_one(rows, tau, "hard", size).collect() if r.kept}
    assert kept == {min((n for n, g in enumerate(expected) if g == c), key=lambda n: (-(n % 7), n)) for c in set(expected)}


def test_semdedup_selection_fills_up_from_the_dropped_rows(spark):
    points = unit(np.array([[1.0, 0], [1.0, 1e-9], [0, 1.0], [-1.0, 0]]))
    rows = frame(spark, points).selectExpr("*", "0 AS cluster", "CAST(row_idx AS DOUBLE) AS distance")
    found = {r.row_idx: r for r in semdedup.choose(rows, 3, 0, 0.99).collect()}
    assert {i for i, r in found.items() if r.kept} == {1, 2, 3} == {i for i, r in found.items() if r.selected}
    assert {r.row_idx for r in semdedup.choose(rows, 4, 0, 0.99).collect() if r.selected} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        semdedup.duplicates(rows, 1.5)
    assert semdedup.duplicates(rows.where("false"), 0.9).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (3, 2)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
    assert graph.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def plain_zcore(points, draws, subspace, neighbours, fall, seed):
    limits = np.array([points.min(axis=0), np.clip(np.round(points.mean(axis=0), 9), points.min(axis=0), points.max(axis=0)), points.max(axis=0)])
    dims, places = zcore.points(limits, draws, subspace, seed)
    score = [int(hashlib.md5(f"{seed}:i{n:03d}".encode()).hexdigest()[:8], 16) / 4294967296 for n in range(len(points))]
    votes = [0] * len(points)
    for d, p in zip(dims, places, strict=True):
        away = [round(sum(abs(x[j] - q) for j, q in zip(d, p, strict=True)), 9) for x in points]
        votes[away.index(min(away))] += 1
    for k, n in enumerate(votes):
        if n:
            away = sorted((round(math.sqrt(max(0.0, 2 - 2 * float(points[k] @ points[j]))), 9), j) for j in range(len(points)) if j != k)[:neighbours]
            share = [1.0 if d <= away[0][0] else (away[0][0] / d) ** fall for d, _ in away]
            for s, (_, j) in zip(share, away, strict=True):
                score[j] -= round(n * s / sum(share), 9)
    return [s + v for s, v in zip(score, votes, strict=True)]


def test_zcore_scores_equal_plain_python(spark):
    rng = np.random.default_rng(6)
    points = unit(np.concatenate((rng.normal(size=(70, 6)), np.repeat(rng.normal(size=(1, 6)), 5, axis=0))))
    rows = frame(spark, points)
    found = {r.row_idx: r for r in zcore.scores(rows, draws=300, subspace=2, neighbours=4, fall=3.0, seed=2).collect()}
    expected = plain_zcore(points, 300, 2, 4, 3.0, 2)
    assert sum(r.votes for r in found.values()) == 300
    assert all(abs(found[i].score - s) < 2e-6 for i, s in enumerate(expected))
    again = {r.row_idx: r.score for r in zcore.scores(rows.repartition(5), draws=300, subspace=2, neighbours=4, fall=3.0, seed=2).collect()}
    assert again == {i: r.score for i, r in found.items()}
    picked = zcore.choose(rows, 9, 2, draws=300, neighbours=4, fall=3.0).where("selected").collect()
    assert {r.row_idx for r in picked} == set(sorted(range(75), key=lambda i: (-found[i].score, i))[:9])
    assert zcore.scores(rows.where("false")).count() == 0


def test_threshold_passes_of_few_picks_write_nothing_and_give_the_same_picks(sparse, monkeypatch):
    _, rows = sparse
    written = []
    monkeypatch.setattr(submodular, "cut", lambda df: written.append(1) or cut(df))
    picks = []
    for told in (submodular.TOLD, 3, 0):
        written.clear()
        found, passes = submodular.threshold(rows, 60, submodular.Survival(np.linspace(1, 3, 9)), 9, 0.2, top=1, parts=3, told=told)
        picks.append((passes, sorted(tuple(r) for r in found.collect())))
        assert (len(written) == 1) == (told == submodular.TOLD)
    assert picks[0] == picks[1] == picks[2]
