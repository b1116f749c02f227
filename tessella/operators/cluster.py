"""Spherical k-means: seeding, Lloyd steps with a fixed point, restarts, and assignment to given prototypes."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vectors as V

log = logging.getLogger(__name__)
#: Passes that draw candidates for seeds, and how many of them a pass draws for each prototype.
ROUNDS, OVER = 4, 2
#: Rows that a task compares with a fit's prototypes at once, rows a task from which tasks grow in number, and numbers of partials from which they are dealt.
TOGETHER, ROWS, SLICE = 4096, 100_000, 1 << 16
EPS = 1e-12
#: Prototypes rest when a pass moves no coordinate by more, which sums in another order may.
STILL = 1e-12


def assigned(rows: DataFrame, prototypes: DataFrame, vector: str = "v") -> DataFrame:
    """Add cluster and distance for prototypes (proto_id, centroid); they come along as one row's array."""
    packed = prototypes.agg(F.array_sort(F.collect_list(F.struct("proto_id", "centroid"))).alias("__prototypes"))
    best = V.nearest(vector, "__prototypes")
    return rows.crossJoin(F.broadcast(packed)).withColumn("__best", best).select(*rows.columns, F.col("__best.cluster").cast("int").alias("cluster"), F.col("__best.distance").alias("distance"))


def prototypes_by(rows: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """(proto_id, centroid, size): the unit vector of the sum of each label's vectors, summed with partials by dimension."""
    each = rows.select(F.col(label).cast("int").alias("proto_id"), F.posexplode(vector).alias("d", "x"))
    sums = each.groupBy("proto_id", "d").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("size"))
    lists = sums.groupBy("proto_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s"), F.max("size").alias("size"))
    return lists.select("proto_id", V.unit(F.transform("s", lambda e: e["x"])).alias("centroid"), "size")


def placed(rows: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """(row_idx, clusters, distances) of rows (row_idx, v): of each fit, the nearest prototype and its distance, in one pass; the first on ties."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches):
            sims = [np.round(x @ c.T, V.PLACES) for c in shared.value]
            label = np.stack([s.argmax(axis=1) for s in sims], axis=1)
            away = np.stack([np.round(np.clip(1.0 - s.max(axis=1), 0.0, 2.0), V.PLACES) for s in sims], axis=1)
            ends = pa.array(np.arange(0, label.size + 1, len(sims)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (label.astype(np.int32), away)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["row_idx", "clusters", "distances"])

    return packed(rows, rows.count()).mapInArrow(run, "row_idx long, clusters array<int>, distances array<double>")


@dataclass
class Fit:
    """Prototypes of the best restart, its objective (summed cosine distance), its seed, and whether it came to rest."""

    centroids: np.ndarray
    objective: float
    seed: int
    converged: bool


def seeds(points: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    """Greedy k-means++ on the sphere over weighted points: of a few draws by weight and distance, the one that lowers the total most."""
    weight = np.ones(len(points)) if weight is None else weight

    def drawn(chance: np.ndarray, n: int) -> np.ndarray:
        total = np.cumsum(chance)
        return np.minimum(np.searchsorted(total, rng.random(n) * total[-1]), len(points) - 1)

    picked = [int(drawn(weight, 1)[0])]
    gap = np.maximum(0.0, 1.0 - points @ points[picked[0]])
    tries = 2 + int(np.log(k))
    while len(picked) < k:
        if (weight * gap).sum() <= 0:
            picked.append(int(rng.integers(len(points))))
            continue
        some = drawn(weight * gap, tries)
        after = [np.minimum(gap, np.maximum(0.0, 1.0 - points @ points[c])) for c in some]
        best = int(np.argmin([(weight * a).sum() for a in after]))
        picked.append(int(some[best]))
        gap = after[best]
    return points[picked].copy()


def pools(blocks: DataFrame, k: int, starts: list[int], rounds: int = ROUNDS, over: int = OVER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each start, candidates for k seeds with their weights, that passes over all packed rows draw by distance, for all starts at once.

    The first pass draws one row a start, each further one the over * k rows of the least exponential times at a rate of their distance to the
    candidates so far, and the last counts the rows nearest to each candidate. Times come from the hash of row_idx, so partitions do not matter.
    On the driver are starts * (1 + rounds * over * k) vectors, whatever the rows.
    """
    held: list[list[np.ndarray]] = [[] for _ in starts]

    def chances(ids: np.ndarray, *salt: int) -> np.ndarray:
        x = ids.astype(np.uint64) ^ np.random.default_rng(salt).integers(1 << 64, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)) + 0.5) / float(1 << 53)

    def near(v: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sim = v @ points.T
        at = sim.argmax(axis=1)
        return at, np.maximum(0.0, 1.0 - sim[np.arange(len(v)), at])

    spark = blocks.sparkSession
    for step in range(rounds + 1):
        most = over * k if step else 1
        shared = spark.sparkContext.broadcast([np.stack(h) if h else None for h in held])

        def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, v in matrices(batches):
                for i, points in enumerate(shared.value):  # noqa: B023
                    gap = near(v, points)[1] if points is not None else np.ones(len(v))
                    time = np.where(gap > EPS, -np.log(chances(ids, starts[i], step)) / np.maximum(gap, EPS), np.inf)  # noqa: B023
                    first = np.lexsort((ids, time))[:most]  # noqa: B023
                    first = first[np.isfinite(time[first])]
                    if len(first) == 0:
                        continue
                    columns = [pa.array(np.full(len(first), i, np.int32)), pa.array(time[first]), pa.array(ids[first]), pa.array(v[first].tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["i", "time", "row_idx", "v"])

        ran = blocks.mapInArrow(race, "i int, time double, row_idx long, v array<double>")
        place = F.row_number().over(W.partitionBy("i").orderBy("time", "row_idx"))
        for r in sorted(ran.withColumn("n", place).where(F.col("n") <= most).select("i", "n", "v").collect()):
            held[r.i].append(np.asarray(r.v))
    points = [np.stack(h) for h in held]
    shared = spark.sparkContext.broadcast(points)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(p)) for p in shared.value]
        for _, v in matrices(batches):
            for i, p in enumerate(shared.value):
                total[i] += np.bincount(near(v, p)[0], minlength=len(p))
        i, j = np.repeat(np.arange(len(total)), [len(t) for t in total]), np.concatenate([np.arange(len(t)) for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate(total))], ["i", "j", "n"])

    weight = [np.zeros(len(p)) for p in points]
    for r in blocks.mapInArrow(count, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        weight[r.i][r.j] = r.n
    return list(zip(points, weight, strict=True))


def spread_seeds(rows: DataFrame, k: int, starts: list[int]) -> np.ndarray:
    """[starts, k, d]: greedy k-means++ over the candidates of each start."""
    return np.stack([seeds(p, k, np.random.default_rng(s), w) for s, (p, w) in zip(starts, pools(packed(rows, rows.count()), k, starts), strict=True)])


def packed(rows: DataFrame, n: int) -> DataFrame:
    """n rows (row_idx, v) as blocks (ids, v) of bytes, dealt over the cores by row_idx and sorted: passes read whole matrices, and sums do not depend on how rows lay."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n // ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, v = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["ids", "v"])

    return rows.select("row_idx", "v").repartition(parts, "row_idx").sortWithinPartitions("row_idx").mapInArrow(run, "ids binary, v binary")


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most TOGETHER rows of packed blocks."""
    for batch in batches:
        for one, two in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.frombuffer(one.as_buffer(), dtype=np.int64)
            v = np.frombuffer(two.as_buffer()).reshape(len(ids), -1)
            for lo in range(0, len(ids), TOGETHER):
                yield ids[lo : lo + TOGETHER], v[lo : lo + TOGETHER]


def pass_over(blocks: DataFrame, fits: list[np.ndarray], spare: int = 0) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, list]:
    """One pass over all packed rows for all fits at once, each of its own k: member sums and counts by prototype, and cosine sums by fit.

    Each task reduces its rows to one partial a prototype; slices of the partials are dealt over tasks and added in the order of their tasks, and a few slices
    reach the driver. Nothing of a pass is kept, so a lost executor costs its tasks alone. With `spare` only the farthest rows that are off their prototype, for empty ones.
    """
    context = blocks.sparkSession.sparkContext
    bounds = np.cumsum([0, *(len(f) for f in fits)])
    d = fits[0].shape[1]
    slices = max(1, min(context.defaultParallelism, int(bounds[-1]) * (d + 2) // SLICE))
    edges = np.linspace(0, bounds[-1], slices + 1).astype(int)
    shared = context.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((bounds[-1], d + 2))
        for _, x in matrices(batches):
            one, at = np.concatenate((x, np.ones((len(x), 1))), axis=1), np.arange(len(x))
            for a, f in zip(bounds, shared.value, strict=False):
                sim = x @ f.T
                label = sim.argmax(axis=1)
                order = np.argsort(label, kind="stable")
                here, start = np.unique(label[order], return_index=True)
                sums[a + here, :-1] += np.add.reduceat(one[order], start)
                sums[a, -1] += sim[at, label].sum()
        if sums.any():
            cut = [sums[p:q].tobytes() for p, q in zip(edges[:-1], edges[1:], strict=True)]
            part = np.full(slices, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array(part), pa.array(cut, pa.binary())], ["at", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, value in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                v = np.frombuffer(value.as_buffer())
                total[at] = total[at] + v if at in total else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["at", "sums"])

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: list[list] = [[] for _ in shared.value]
        for ids, x in matrices(batches):
            for i, f in enumerate(shared.value):
                best = (x @ f.T).max(axis=1)
                far[i] = sorted([*far[i], *((float(best[j]), int(ids[j]), x[j].tolist()) for j in np.lexsort((ids, best))[:spare] if 1.0 - best[j] > EPS)])[:spare]
        rows = [(i, *r) for i, found in enumerate(far) for r in found]
        columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "sim", "row_idx", "v"])

    try:
        if spare:
            place = F.row_number().over(W.partitionBy("i").orderBy("sim", "row_idx"))
            ran = blocks.mapInArrow(farthest, "i int, sim double, row_idx long, v array<double>").withColumn("n", place).where(F.col("n") <= spare)
            return [], [], np.zeros(0), [(r.i, r.sim, r.v) for r in sorted(ran.select("i", "n", "sim", "v").collect(), key=lambda r: (r.i, r.n))]
        parts = blocks.mapInArrow(run, "at int, part int, sums binary")
        added = parts.repartition(slices, "at").sortWithinPartitions("at", "part").mapInArrow(add, "at int, sums binary").collect()
    finally:
        shared.destroy()
    table = np.zeros((bounds[-1], d + 2))
    for r in added:
        table[edges[r.at] : edges[r.at + 1]] = np.frombuffer(r.sums).reshape(-1, d + 2)
    cut = [table[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [c[:, :d] for c in cut], [c[:, d] for c in cut], np.array([c[0, d + 1] for c in cut]), []


def fit(rows: DataFrame, k: int, seed: int = 0, restarts: int = 10, most: int = 300, reseed: str = "off_prototype", init: str = "plusplus") -> Fit:
    """Spherical k-means over (row_idx, v), v unit vectors; the restart of the least summed distance, the earliest on ties.

    The restarts of a seed share its candidates, over all rows at any size, and draw from them by seed * restarts + i. A restart rests when a pass moves
    no prototype. An empty prototype takes the farthest row: with reseed="off_prototype" only one that is off its own prototype.
    `init="first_k"` starts from the first k rows by row_idx.
    """
    return fit_all(rows, [(k, seed)], restarts, most, reseed, init)[k, seed]


def fit_all(rows: DataFrame, jobs: list[tuple[int, int]], restarts: int = 10, most: int = 300, reseed: str = "off_prototype", init: str = "plusplus") -> dict[tuple[int, int], Fit]:
    """fit() for each (k, seed) of jobs, in one set of passes: all fits that do not rest yet are in each pass."""
    rows = rows.select("row_idx", "v").persist()
    n = rows.count()
    blocks = packed(rows, n).persist()
    try:
        for k, _ in jobs:
            if not 1 <= k <= n:
                raise ValueError(f"{n} rows make no k={k} prototypes")
        if init == "first_k":
            restarts, top = 1, max(k for k, _ in jobs)
            first = np.stack([np.asarray(x[1]) for x in sorted(rows.orderBy("row_idx").limit(top).collect())])
            starts = {(job, 0): first[: job[0]] for job in jobs}
        else:
            named = list(dict.fromkeys(seed for _, seed in jobs))
            pool = dict(zip(named, pools(blocks, max(k for k, _ in jobs), named), strict=True))
            starts = {((k, seed), i): seeds(pool[seed][0], k, np.random.default_rng(seed * restarts + i), pool[seed][1]) for k, seed in jobs for i in range(restarts)}
        done = rest(blocks, starts, n, most, reseed)
    finally:
        blocks.unpersist()
        rows.unpersist()
    out = {}
    for job in jobs:
        best = min(range(restarts), key=lambda i: (round(done[job, i][0], V.PLACES), i))  # noqa: B023
        objective, centroids, converged = done[job, best]
        out[job] = Fit(centroids, float(objective), job[1] * restarts + best, converged)
    return out


def rest(blocks: DataFrame, starts: dict, n: int, most: int, reseed: str) -> dict:
    """(objective, prototypes, at rest) of each start after Lloyd passes until its prototypes are the means of their own members."""
    done, live = {}, dict(starts)
    for _ in range(most):
        names, now = list(live), list(live.values())
        sums, counts, total, _ = pass_over(blocks, now)
        norms = [np.linalg.norm(s, axis=1) for s in sums]
        after = [np.where((m <= EPS)[:, None], c, s / np.where(m <= EPS, 1.0, m)[:, None]) for m, c, s in zip(norms, now, sums, strict=True)]
        missing = max(int((m <= EPS).sum()) for m in norms)
        if missing:
            *_, far = pass_over(blocks, now, spare=missing)
            for j, m in enumerate(norms):
                spare = [f for f in far if f[0] == j and (reseed == "any" or 1.0 - f[1] > EPS)]
                for c, f in zip(np.flatnonzero(m <= EPS), spare, strict=False):
                    after[j][c] = f[2]
        for j, name in enumerate(names):
            if np.abs(after[j] - now[j]).max() <= STILL:
                done[name] = (n - total[j], now[j], True)
                del live[name]
            else:
                live[name] = after[j]
        if not live:
            return done
    log.warning("%d fits did not rest within %d passes", len(live), most)
    *_, total, _ = pass_over(blocks, list(live.values()))
    for j, (name, centroids) in enumerate(live.items()):
        done[name] = (n - total[j], centroids, False)
    return done


def silhouettes(rows: DataFrame, fits: list[np.ndarray]) -> list[float | None]:
    """silhouette() of rows (row_idx, v) under each of several fits, in two passes: the fits' member sums, then every row against them."""
    blocks = packed(rows, rows.count()).persist()
    sums, counts, _, _ = pass_over(blocks, fits)
    bounds = np.cumsum([0, *(len(f) for f in fits)])
    shared = rows.sparkSession.sparkContext.broadcast((np.concatenate(fits), np.concatenate(sums), np.concatenate(counts), bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sums, counts, bounds = shared.value
        total, seen = np.zeros(len(bounds) - 1), 0
        for _, x in matrices(batches):
            seen, at = seen + len(x), np.arange(len(x))
            for i, (p, q) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                label, cos, size = (x @ centres[p:q].T).argmax(axis=1), x @ sums[p:q].T, counts[p:q]
                own = size[label]
                a = 1.0 - (cos[at, label] - 1.0) / np.maximum(own - 1, 1)
                away = np.where(size > 0, 1.0 - cos / np.maximum(size, 1), np.inf)
                away[at, label] = np.inf
                b = away.min(axis=1)
                top = np.maximum(a, b)
                total[i] += np.where((own > 1) & np.isfinite(b) & (top != 0), (b - a) / np.where(top == 0, 1.0, top), 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), seen))], ["i", "s", "n"])

    found = {r.i: r.s / r.n for r in blocks.mapInArrow(run, "i long, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect() if r.n}
    blocks.unpersist()
    return [found.get(i) if (c > 0).sum() > 1 else None for i, c in enumerate(counts)]


def as_prototypes(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "proto_id int, centroid array<double>")


def scored(rows: DataFrame, k: int, seed: int = 0, restarts: int = 10, most: int = 300) -> tuple[DataFrame, Fit]:
    """Rows with cluster and distance to the prototypes of the best restart."""
    best = fit(rows, k, seed, restarts, most)
    found = placed(rows, [best.centroids]).select("row_idx", F.col("clusters")[0].alias("cluster"), F.col("distances")[0].alias("distance"))
    return rows.join(found, "row_idx"), best


def silhouette(rows: DataFrame) -> float | None:
    """Mean cosine silhouette of (v, cluster) in linear time, from the clusters' vector sums; null for fewer than two clusters.

    The mean cosine of a row to a cluster is its product with the cluster's sum over the size, so no pairs are made.
    """
    sums = rows.select("cluster", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    packed = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("s"), F.max("n").alias("n"))
    one = packed.agg(F.collect_list(F.struct("cluster", "s", "n")).alias("all"))
    each = rows.crossJoin(F.broadcast(one))
    own = F.filter("all", lambda c: c["cluster"] == F.col("cluster"))[0]
    a = F.when(own["n"] > 1, 1.0 - (V.dot("v", own["s"]) - 1.0) / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("all", lambda c: c["cluster"] != F.col("cluster")), lambda c: 1.0 - V.dot("v", c["s"]) / c["n"]))
    value = each.select(a.alias("a"), b.alias("b")).select(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    return value.agg(F.avg("s")).first()[0] if packed.count() > 1 else None
