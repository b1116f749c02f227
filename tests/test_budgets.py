"""Fair shares, regions and comparisons of methods against plain Python on small tables."""

import itertools
import random

import numpy as np
import pytest

from tessella.operators import balance, stats


def filled(sizes, budget):
    share = dict.fromkeys(sizes, 0)
    while budget and any(share[c] < n for c, n in sizes.items()):
        for c in sorted(sizes):
            # One round deals one row to each class with room, as far as the budget goes.
            if budget and share[c] < sizes[c]:
                share[c] += 1
                budget -= 1
    return share


@pytest.mark.parametrize("budget", [0, 1, 5, 17, 40, 41, 77, 10_000])
def test_fair_shares_equal_dealing_one_by_one(spark, budget):
    sizes = {"a": 3, "b": 40, "c": 1, "d": 0, "e": 33, "f": 3}
    table = spark.createDataFrame(list(sizes.items()), "class_id string, size long")
    found = {r.class_id: r.share for r in balance.fair_shares(table, budget).collect()}
    assert found == filled(sizes, budget)


def test_class_balanced_draws_shares_and_knows_null_classes(spark):
    rows = [(i, i, "hot" if i % 3 else ("" if i % 2 else None)) for i in range(90)]
    items = spark.createDataFrame(rows, "image_id long, row_idx long, class_id string")
    got = balance.class_balanced(items, 50, 1).where("selected").collect()
    count = lambda c: sum(r.class_id == c for r in got)
    assert (count("hot"), count(""), count(None)) == (20, 15, 15) and len({r.image_id for r in got}) == 50
    assert {r.image_id for r in balance.class_balanced(items.repartition(5), 50, 1).where("selected").collect()} == {r.image_id for r in got}
    with pytest.raises(ValueError):
        balance.class_balanced(items, 91)
    assert balance.class_balanced(items.where("false"), 0).count() == 0


def searched(grid):
    h, w = grid.shape
    region = np.full((h, w), -1)
    for y, x in itertools.product(range(h), range(w)):
        if grid[y, x] < 0 or region[y, x] >= 0:
            continue
        queue, region[y, x] = [(y, x)], y * w + x
        while queue:
            a, b = queue.pop()
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < h and 0 <= d < w and region[c, d] < 0 and grid[c, d] == grid[a, b]:
                    region[c, d] = y * w + x
                    queue.append((c, d))
    return region


def test_regions_equal_a_search(spark):
    rng = np.random.default_rng(4)
    spiral = np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]])
    grids = [rng.integers(-1, 2, (7, 5)) for _ in range(20)] + [np.zeros((7, 5), int), spiral, np.full((1, 5), -1)]
    for grid in grids:
        assert (balance.labelled(grid) == searched(grid)).all()
    patches = [(n, i, int(p)) for n, g in enumerate(grids) for i, p in enumerate(g.ravel()) if p >= 0] + [(None, 1, 1), (3, 2, None)]
    found = balance.regions(spark.createDataFrame([p for p in patches if (p[0], p[1]) != (3, 2) or p[2] is None], "image_id long, patch_idx int, proto_id int"), 5).collect()
    grids[3].ravel()[2] = -1
    expected = set()
    for n, g in enumerate(grids):
        region = searched(g)
        expected |= {(n, int(r), int(g.ravel()[r]), int((region == r).sum())) for r in np.unique(region[region >= 0])}
    assert {tuple(r) for r in found} == expected


def test_regions_are_chosen_as_by_a_plain_greedy(spark):
    rng = random.Random(3)
    rows = [(i, 0, rng.choice([0, 0, 0, 1, 1, 2]), rng.randint(1, 9)) for i in range(60)]
    table = spark.createDataFrame(rows, "image_id long, region int, proto_id int, pixels long")
    total = sum(r[3] for r in rows)
    freq = {p: sum(r[3] for r in rows if r[2] == p) / total for p in (0, 1, 2)}
    covered, order, left = dict.fromkeys(freq, 0), [], list(rows)
    while left:
        worth = lambda r: round(freq[r[2]] ** -0.8 * ((covered[r[2]] + r[3]) ** 0.5 - covered[r[2]] ** 0.5) / r[3], 9)
        best = min(left, key=lambda r: (-worth(r), r[2], r[3], r[0]))
        order.append(best)
        covered[best[2]] += best[3]
        left.remove(best)
    for budget in (0, 50, total):
        chosen = balance.choose_regions(table, budget, rarity=0.8).where("selected").orderBy("keep_rank").collect()
        taken = list(itertools.accumulate(r[3] for r in order))
        assert [(r.image_id, r.taken) for r in chosen] == [(r[0], t) for r, t in zip(order, taken, strict=True) if t <= budget]


def test_running_sums_hold_over_blocks(spark):
    rows = spark.createDataFrame([(i + 1, i % 2, i) for i in range(40)], "at long, g int, x long")
    found = {r.at: r.s for r in balance.running(rows, "g", "at", "x", "s", 40, block=7).collect()}
    assert found == {i + 1: sum(range(i % 2, i + 1, 2)) for i in range(40)}


def enumerated(differences):
    used = [d for d in differences if d != 0]
    sizes = sorted(abs(d) for d in used)
    rank = {s: np.mean([i + 1 for i, x in enumerate(sizes) if x == s]) for s in sizes}
    plus = sum(rank[abs(d)] for d in used if d > 0)
    minus = sum(rank[abs(d)] for d in used if d < 0)
    sums = [sum(rank[abs(d)] for d, keep in zip(used, signs, strict=True) if keep) for signs in itertools.product([0, 1], repeat=len(used))]
    return len(used), plus, minus, min(1.0, 2 * sum(s <= min(plus, minus) + 1e-9 for s in sums) / len(sums))


def test_signed_ranks_equal_full_enumeration(spark):
    rng = random.Random(1)
    groups = {"ties": [1, 1, -1, 2, 2, 2, -3, 0, 0], "plain": [rng.uniform(-1, 2) for _ in range(12)], "zero": [0.0, 0.0], "one": [5.0], "same": [1.0] * 10}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("plain", None), ("none", None)]
    found = {r.method: r for r in stats.signed_ranks(spark.createDataFrame(rows, "method string, difference double")).collect()}
    assert set(found) == set(groups)
    for g, xs in groups.items():
        n, plus, minus, p = enumerated([round(float(x), 9) for x in xs])
        assert (found[g].n_pairs, found[g].n_used, found[g].w_plus, found[g].w_minus) == (len(xs), n, plus, minus) and abs(found[g].p_value - p) < 1e-8


def test_signed_ranks_of_many_pairs_use_the_normal_tail(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("m", rng.choice([-2, -1, 1, 2, 3]) + 0.01 * rng.random()) for _ in range(120)]
    table = spark.createDataFrame(rows, "method string, difference double")
    near = stats.signed_ranks(table).first().p_value
    monkeypatch.setattr(stats, "EXACT", 10)
    assert 0 < near < 1 and abs(stats.signed_ranks(table).first().p_value - near) < 0.05 * near + 1e-3


def test_area_reads_ends_off_the_lines_and_needs_them(spark):
    rows = [("flat", 0.1, 3.0), ("flat", 0.5, 3.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("bent", 0.1, 0.0), ("bent", 0.2, 1.0), ("bent", 0.2, 3.0), ("bent", 0.6, 2.0), ("short", 0.2, 1.0), ("short", 0.3, 1.0), ("one", 0.2, 1.0), ("line", None, 4.0), ("line", 0.3, None)]
    table = spark.createDataFrame(rows, "method string, ratio double, value double")
    found = {r.method: r.auc for r in stats.area(table, low=0.1, high=0.5).collect()}
    assert found["flat"] == 3.0 and found["line"] == 0.3 and found["short"] is None and found["one"] is None
    assert found["bent"] == pytest.approx((0.1 * 1.0 + 0.3 * (2 + 2) / 2) / 0.4)
    both = {r.method: (r.low, r.high, r.auc) for r in stats.area(table.where("method IN ('flat', 'bent')")).collect()}
    assert both["flat"] == (0.1, 0.5, 3.0)
