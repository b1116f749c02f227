"""Greedy choice under monotone submodular objectives: exact by lazy passes, or within a factor by threshold passes.

Rows are (row_idx, protos, masses, bonus): sparse masses on k prototypes, and an own value that is added to a row's gain whatever is
picked. The state of an objective is the sum of the picked rows' masses, k numbers, so that the state after any set of rows is a sum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut, ranked

PLACES = 9
TOP = 4096
#: Of exact(): rows that a pass brings to the driver, rows and masses that stay there between passes, and the rows that a pick is looked for in at once.
FETCH, HELD, WINDOW = 1 << 14, 1 << 22, 512
#: Picked rows that a pass is told of; beyond it they leave the table.
TOLD = 8192
ROW = "row_idx long, protos array<int>, masses array<double>, bonus double"
PACKED = "n long, entries long, ids binary, sizes binary, protos binary, masses binary, bonus binary"


@dataclass(frozen=True)
class Power:
    """The sum over prototypes of covered mass to the power alpha."""

    alpha: float

    def parts(self, here: np.ndarray, protos: np.ndarray, masses: np.ndarray) -> np.ndarray:
        return (here + masses) ** self.alpha - here**self.alpha


@dataclass(frozen=True)
class Survival:
    """The sum over prototypes of weight * (1 - exp(-mass)): the chance that a concept is met, masses being minus the logs of the chances to miss it."""

    weights: np.ndarray

    def parts(self, here: np.ndarray, protos: np.ndarray, masses: np.ndarray) -> np.ndarray:
        return self.weights[protos] * np.exp(-here) * -np.expm1(-masses)


@dataclass
class Block:
    """A batch of rows with their sparse masses laid flat; owner is the row of each entry."""

    ids: np.ndarray
    owner: np.ndarray
    protos: np.ndarray
    masses: np.ndarray
    bonus: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        lists = batch.column(batch.schema.get_field_index("protos"))
        sizes = np.diff(np.asarray(lists.offsets))
        at = lambda name: batch.column(batch.schema.get_field_index(name))
        return cls(np.asarray(at("row_idx")), np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten()), np.asarray(at("masses").flatten()), np.asarray(at("bonus")))

    @classmethod
    def laid(cls, rows: list) -> Block:
        """Of Row objects."""
        flat = lambda name, kind: np.array([x for r in rows for x in r[name]], dtype=kind)
        return cls(np.array([r.row_idx for r in rows]), np.repeat(np.arange(len(rows)), [len(r.protos) for r in rows]), flat("protos", np.int64), flat("masses", float), np.array([r.bonus for r in rows]))

    @classmethod
    def read(cls, row) -> Block:
        """Of a row of packed()."""
        sizes = np.frombuffer(row["sizes"], np.int32)
        return cls(np.frombuffer(row["ids"], np.int64), np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(row["protos"], np.int32), np.frombuffer(row["masses"]), np.frombuffer(row["bonus"]))

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        before = np.cumsum([0, *(len(b.ids) for b in blocks)])
        return cls(*(np.concatenate([getattr(b, name) + (n if name == "owner" else 0) for b, n in zip(blocks, before, strict=False)]) for name in ("ids", "owner", "protos", "masses", "bonus")))

    def bytes(self) -> pa.RecordBatch:
        sizes = np.bincount(self.owner, minlength=len(self.ids)).astype(np.int32)
        parts = (self.ids.astype(np.int64), sizes, self.protos.astype(np.int32), self.masses, self.bonus)
        return pa.RecordBatch.from_arrays([pa.array([len(self.ids)]), pa.array([len(self.protos)]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["n", "entries", "ids", "sizes", "protos", "masses", "bonus"])

    def taken(self, at: np.ndarray) -> Block:
        """The rows at those places, in that order."""
        sizes = np.bincount(self.owner, minlength=len(self.ids))
        start, own = np.cumsum(sizes) - sizes, sizes[at]
        entries = np.repeat(start[at] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        return Block(self.ids[at], np.repeat(np.arange(len(at)), own), self.protos[entries], self.masses[entries], self.bonus[at])

    def gains(self, objective, state: np.ndarray) -> np.ndarray:
        return self.summed(objective.parts(state[self.protos], self.protos, self.masses))

    def summed(self, parts: np.ndarray) -> np.ndarray:
        return np.round(np.bincount(self.owner, weights=parts, minlength=len(self.ids)) + self.bonus, PLACES)

    def before(self, among: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state that each entry of the rows `among` meets when all earlier rows of `among` are picked."""
        entry = among[self.owner]
        here = state[self.protos]
        at = np.flatnonzero(entry)
        order = at[np.lexsort((self.owner[at], self.protos[at]))]
        running = np.concatenate(([0.0], np.cumsum(self.masses[order])))
        head = np.concatenate(([True], self.protos[order][1:] != self.protos[order][:-1])) if len(order) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
        here[order] += running[:-1] - running[start] if len(order) else 0.0
        return here

    def total(self, among: np.ndarray, k: int) -> np.ndarray:
        entry = among[self.owner]
        return np.bincount(self.protos[entry], weights=self.masses[entry], minlength=k)


def lazy_pass(rows: DataFrame, objective, state: np.ndarray, order: list[tuple[int, float]], budget: int, gone: set[int], top: int) -> np.ndarray:
    """One pass of exact greedy: the `top` rows of the largest gain come to the driver, which picks while a pick is sure to beat all others. Returns the new state."""
    shared = rows.sparkSession.sparkContext.broadcast((objective, state, np.fromiter(gone, dtype=np.int64, count=len(gone))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objective, state, gone = shared.value
        for batch in batches:
            block = Block.of(batch)
            gain = block.gains(objective, state)
            left = np.flatnonzero(~np.isin(block.ids, gone))
            best = left[np.lexsort((block.ids[left], -gain[left]))[: top + 1]]
            yield batch.take(pa.array(best)).append_column("gain", pa.array(gain[best]))

    found = rows.mapInArrow(run, ROW + ", gain double").orderBy(F.desc("gain"), "row_idx").limit(top + 1).collect()
    bound = (-found[top].gain, found[top].row_idx) if len(found) > top else (np.inf, 0)
    held = {r.row_idx: (np.asarray(r.protos, dtype=np.int64), np.asarray(r.masses), r.bonus) for r in found[:top]}
    heap = [(-r.gain, r.row_idx) for r in found[:top]]
    heapq.heapify(heap)
    state, fresh = state.copy(), True
    while heap and len(order) < budget:
        _, at = heapq.heappop(heap)
        protos, masses, bonus = held[at]
        value = float(np.round(objective.parts(state[protos], protos, masses).sum() + bonus, PLACES))
        if heap and heap[0] < (-value, at):
            heapq.heappush(heap, (-value, at))
            continue
        if not fresh and bound < (-value, at):
            break
        np.add.at(state, protos, masses)
        order.append((at, value))
        fresh = False
    return state


def check(rows: DataFrame, budget: int) -> None:
    if budget < 0 or budget > rows.count():
        raise ValueError(f"budget={budget} is out of range")


def packed(rows: DataFrame) -> DataFrame:
    """Rows as blocks of bytes, which passes read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield Block.of(batch).bytes()

    return rows.select("row_idx", "protos", "masses", "bonus").mapInArrow(run, PACKED)


def without(blocks: DataFrame, gone: np.ndarray) -> DataFrame:
    """Packed blocks without the rows of sorted ids."""
    shared = blocks.sparkSession.sparkContext.broadcast(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                yield block.taken(np.flatnonzero(~np.isin(block.ids, shared.value))).bytes()

    return blocks.mapInArrow(run, PACKED)


def largest(blocks: DataFrame, objective, state: np.ndarray, known: np.ndarray, top: int) -> tuple[list[Block], tuple[float, int]]:
    """About `top` rows of the largest gains that are not in `known`, sorted ids, and the (-gain, row_idx) that all others come after.

    Tasks first name the gains at every so many of their ranks, which give a bound; then the rows up to it alone travel, so what reaches the driver
    does not grow with the number of tasks' rows.
    """
    context = blocks.sparkSession.sparkContext
    step = max(1, top // max(64, blocks.rdd.getNumPartitions()))
    shared = context.broadcast((objective, state, known))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
        objective, state, known = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                left = ~np.isin(block.ids, known)
                yield block, left, block.gains(objective, state)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, ids = np.zeros(0), np.zeros(0, np.int64)
        for block, left, value in open_(batches):
            gain, ids = np.append(gain, value[left]), np.append(ids, block.ids[left])
            first = np.lexsort((ids, -gain))[: top + step]
            gain, ids = gain[first], ids[first]
        yield pa.RecordBatch.from_arrays([pa.array([x[step - 1 :: step].tobytes()], pa.binary()) for x in (gain, ids)], ["gain", "ids"])

    named = blocks.mapInArrow(marks, "gain binary, ids binary").collect()
    gain, ids = (np.concatenate([np.frombuffer(r[i], kind) for r in named] or [np.zeros(0, kind)]) for i, kind in enumerate((np.float64, np.int64)))
    order = np.lexsort((ids, -gain))[: max(1, top // step)]
    whole = len(order) < max(1, top // step)
    bound = (np.inf, 0) if whole else (-gain[order[-1]], int(ids[order[-1]]))

    def up_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, left, value in open_(batches):
            at = np.flatnonzero(left & ((-value < bound[0]) | ((-value == bound[0]) & (block.ids <= bound[1]))))
            if len(at):
                yield block.taken(at).bytes()

    found = [Block.read(r) for r in blocks.mapInArrow(up_to, PACKED).collect()]
    shared.destroy()
    return found, bound


def pick(held: Block, objective, state: np.ndarray, order: list[tuple[int, float]], budget: int, bound: tuple[float, int]) -> tuple[Block, np.ndarray]:
    """Picks of `held` while they come before `bound`, which no other row does. Returns what is left of it, and the new state.

    As gains only shrink, a pick is looked for among the WINDOW rows of the largest gains as long as it comes before all others' earlier gains.
    """
    state = state.copy()
    while len(order) < budget and len(held.ids):
        gain = held.gains(objective, state)
        first = np.lexsort((held.ids, -gain))[: WINDOW + 1]
        limit = min(bound, (-gain[first[WINDOW]], int(held.ids[first[WINDOW]]))) if len(first) > WINDOW else bound
        first = first[:WINDOW]
        first = first[np.argsort(held.ids[first])]
        near, left = held.taken(first), np.ones(len(first), bool)
        while len(order) < budget and left.any():
            now = np.where(left, near.gains(objective, state), -np.inf)
            at = int(now.argmax())
            if (-now[at], int(near.ids[at])) > limit:
                break
            own = near.owner == at
            np.add.at(state, near.protos[own], near.masses[own])
            order.append((int(near.ids[at]), float(now[at])))
            left[at] = False
        if left.all():
            break
        kept = np.ones(len(held.ids), bool)
        kept[first[~left]] = False
        held = held.taken(np.flatnonzero(kept))
    return held, state


def exact(rows: DataFrame, budget: int, objective, k: int, top: int = FETCH) -> list[tuple[int, float]]:
    """(row_idx, gain) in the order of plain greedy, the first row on ties.

    Gains only shrink as rows are picked, so a pass's gains bound later ones. A pass brings about `top` rows that are not on the driver yet, and those not
    picked stay there, up to HELD masses: a row hardly travels twice, whatever the number of passes. For budgets of many millions use threshold(), as
    the picks' numbers are on the driver. Passes are told of at most TOLD picks; then those leave the table.
    """
    blocks = packed(rows).persist()
    n, entries = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    if budget < 0 or budget > n:
        raise ValueError(f"budget={budget} is out of range")
    top = max(1, min(top, HELD // 4 * n // max(1, entries)))
    state, order, told, held = np.zeros(k), [], 0, []
    while len(order) < budget:
        if len(order) - told > TOLD:
            whole, blocks = blocks, cut(without(blocks, np.sort(np.array([i for i, _ in order[told:]], dtype=np.int64))))
            whole.unpersist()
            told = len(order)
        known = np.sort(np.concatenate([np.array([i for i, _ in order[told:]], dtype=np.int64), *(b.ids for b in held)]))
        new, bound = largest(blocks, objective, state, known, top)
        left, state = pick(Block.joined([*held, *new]), objective, state, order, budget, bound)
        if len(left.ids) + len(left.protos) > HELD:
            left = left.taken(np.sort(np.lexsort((left.ids, -left.gains(objective, state)))[: len(left.ids) // 2]))
        held = [left]
    blocks.unpersist()
    return order


def threshold(rows: DataFrame, budget: int, objective, k: int, eps: float = 0.1, top: int = TOP, parts: int | None = None, told: int = TOLD) -> tuple[DataFrame, int]:
    """(row_idx, keep_rank, gain) of picks that each gain at least (1 - eps) of what any row could, and the number of passes.

    So the value is at least 1 - exp(-(1 - eps)) of the best. After one lazy pass, each pass lowers a threshold to (1 - eps) of the
    largest gain, if no row is above it, and takes the rows above it in a fixed order: every task first sums the masses of its candidates, and a
    candidate is picked if it is above the threshold even after all candidates before it, of its task and of earlier ones. Sums of k numbers a task
    reach the driver. A pass writes its picks alone; those of passes of at most `told` in all are told to later passes, which skip them, and picks of larger
    ones stay in Spark and leave the table. The number of passes depends on how often the largest gain falls by eps, not on the budget.
    """
    check(rows, budget)
    spark = rows.sparkSession

    def placed(rows: DataFrame) -> DataFrame:
        # Without a number, adaptive execution makes no more tasks than the rows' bytes ask for.
        return cut(rows.select("row_idx", "protos", "masses", "bonus").repartition(*([parts] if parts else []), F.xxhash64("row_idx")).sortWithinPartitions(F.xxhash64("row_idx", F.lit(1)), "row_idx"))

    left = placed(rows)
    head: list[tuple[int, float]] = []
    state, passes = lazy_pass(left, objective, np.zeros(k), head, budget, set(), top), 1
    gone = np.array(sorted(i for i, _ in head), dtype=np.int64)
    # Picks that passes are told of, and frames of those that left the table.
    listed, found = [(i, n + 1, g) for n, (i, g) in enumerate(head)], []
    done, level, few = len(head), np.inf, max(1, told // max(1, left.rdd.getNumPartitions()))

    def sums(state: np.ndarray, level: float) -> dict[int, tuple[float, int, np.ndarray]]:
        shared = spark.sparkContext.broadcast((objective, state, gone))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            objective, state, gone = shared.value
            best, n, total = -np.inf, 0, np.zeros(k)
            for batch in batches:
                block = Block.of(batch)
                gain = np.where(np.isin(block.ids, gone), -np.inf, block.gains(objective, state))
                among = gain >= level
                best, n, total = max(best, gain.max(initial=-np.inf)), n + int(among.sum()), total + block.total(among, k)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([best]), pa.array([n]), pa.array([total.tolist()])], ["part", "best", "n", "total"])

        return {r.part: (r.best, r.n, np.array(r.total)) for r in left.mapInArrow(run, "part int, best double, n long, total array<double>").collect()}

    def accepted(state: np.ndarray, level: float, offsets: dict[int, np.ndarray]) -> DataFrame:
        shared = spark.sparkContext.broadcast((objective, state, gone, offsets))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            objective, state, gone, offsets = shared.value
            part = TaskContext.get().partitionId()
            met, n = state + offsets[part], 0
            for batch in batches:
                block = Block.of(batch)
                open_ = ~np.isin(block.ids, gone)
                among = open_ & (block.gains(objective, state) >= level)
                sure = block.summed(objective.parts(block.before(among, met), block.protos, block.masses))
                picked = among & (sure >= level)
                met = met + block.total(among, k)
                place = np.where(picked, n + np.cumsum(picked), 0)
                n += int(picked.sum())
                columns = [pa.array(picked), pa.array(np.full(len(place), part, np.int32)), pa.array(place), pa.array(sure)]
                out = pa.RecordBatch.from_arrays([*batch.columns, *columns[1:]], [*batch.schema.names, "part", "place", "gain"])
                yield out.filter(columns[0])

        return left.mapInArrow(run, ROW + ", part int, place long, gain double")

    def near(state: np.ndarray, level: float, most: int) -> dict[int, Block] | None:
        """The candidates of each task, in its order; None if one has more than `most`."""
        shared = spark.sparkContext.broadcast((objective, state, gone))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            objective, state, gone = shared.value
            n = 0
            for batch in batches:
                block = Block.of(batch)
                own = batch.filter(pa.array(~np.isin(block.ids, gone) & (block.gains(objective, state) >= level))).slice(0, most + 1 - n)
                n += own.num_rows
                yield own.append_column("part", pa.array(np.full(own.num_rows, TaskContext.get().partitionId(), np.int32)))

        by: dict[int, list] = {}
        for r in left.mapInArrow(run, ROW + ", part int").collect():
            by.setdefault(r.part, []).append(r)
        return None if any(len(rows) > most for rows in by.values()) else {part: Block.laid(by[part]) for part in sorted(by)}

    def covered(picks: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(k)
            for batch in batches:
                block = Block.of(batch)
                n, total = n + len(block.ids), total + block.total(np.ones(len(block.ids), dtype=bool), k)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([total.tolist()])], ["part", "n", "total"])

        return {r.part: (r.n, np.array(r.total)) for r in picks.select("row_idx", "protos", "masses", "bonus").mapInArrow(run, "part int, n long, total array<double>").collect()}

    while done < budget:
        seen = sums(state, level)
        best = max(b for b, _, _ in seen.values())
        if best <= 0:
            break
        counted = sum(n for _, n, _ in seen.values())
        if not counted:
            level = (1.0 - eps) * best
        held = near(state, level, few) if counted <= few * len(seen) and len(gone) < told else None
        while held is not None and done < budget:
            # All candidates of this threshold are here, so its passes end here.
            met, new, passes = state, [], passes + 1
            for block in held.values():
                among = ~np.isin(block.ids, gone) & (block.gains(objective, state) >= level)
                sure = block.summed(objective.parts(block.before(among, met), block.protos, block.masses))
                met = met + block.total(among, k)
                new += [(block, i, float(sure[i])) for i in np.flatnonzero(among & (sure >= level))]
            if not new:
                passes -= 1
                break
            listed += [(int(block.ids[i]), done + n + 1, g) for n, (block, i, g) in enumerate(new)]
            done += len(new)
            gone = np.sort(np.append(gone, [block.ids[i] for block, i, _ in new])).astype(np.int64)
            for block in held.values():
                state = state + block.total(np.isin(np.arange(len(block.ids)), [i for b, i, _ in new if b is block]), k)
        if held is not None:
            continue
        if not counted:
            seen = sums(state, level)
        passes += 1
        offsets, so_far = {}, np.zeros(k)
        for part in sorted(seen):
            offsets[part] = so_far
            so_far = so_far + seen[part][2]
        picks = cut(accepted(state, level, offsets))
        counts, before = covered(picks), []
        for part in sorted(counts):
            before.append((part, done))
            done += counts[part][0]
            state = state + counts[part][1]
        if len(gone) + sum(n for n, _ in counts.values()) <= told:
            ranks = dict(before)
            new = [(r.row_idx, ranks[r.part] + r.place, r.gain) for r in picks.select("row_idx", "part", "place", "gain").collect()]
            listed += new
            gone = np.sort(np.append(gone, np.array([i for i, _, _ in new], dtype=np.int64)))
            continue
        ranks = spark.createDataFrame(before, "part int, before long")
        found.append(picks.join(F.broadcast(ranks), "part").select("row_idx", (F.col("before") + F.col("place")).alias("keep_rank"), "gain"))
        away = picks.select("row_idx").unionByName(spark.createDataFrame([(int(i),) for i in gone], "row_idx long"))
        left, gone = placed(left.join(away, "row_idx", "left_anti")), np.zeros(0, np.int64)
    found.append(spark.createDataFrame(listed, "row_idx long, keep_rank long, gain double"))
    picked = reduce(DataFrame.unionByName, found).where(F.col("keep_rank") <= budget)
    if done < budget:
        # Nothing gains any more: plain greedy would go on with the first rows.
        rest = left.join(spark.createDataFrame([(int(i),) for i in gone], "row_idx long"), "row_idx", "left_anti") if len(gone) else left
        rest = ranked(rest.select("row_idx"), [F.asc("row_idx")], "place").where(F.col("place") <= budget - done)
        picked = picked.unionByName(rest.select("row_idx", (F.col("place") + done).alias("keep_rank"), F.lit(0.0).alias("gain")))
    return picked, passes
