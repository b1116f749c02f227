"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model fitted by dual coordinate descent.

Features are hashed indicators of one and two words, and of one to three words' shapes (runs of capitals, letters, digits and marks; a
pair of shapes also tells whether its words are equal). A row is scaled to unit length, so long texts do not outweigh short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.quality import per_row

BITS = 18
BUCKETS = 1 << BITS
#: Labelled rows of each class that the model is fitted on, and the longest of their texts.
LABELLED = 5_000
FIT_CHARS = 50_000
FOLDS, HELD = 4, 2
CALIBRATION = 5
SMOOTH, COST, PASSES, REST = 1.0, 1.0, 30, 1e-3
THRESHOLD = 0.7
UNIT = 1 << 24
#: Shape classes of bytes: capitals, other letters (all beyond ASCII too), digits, and each mark by itself.
SHAPES = np.arange(256, dtype=np.uint64)
SHAPES[65:91] = 1
SHAPES[97:123] = SHAPES[128:] = 2
SHAPES[48:58] = 3


def held_out(doc_id: Column | str) -> Column:
    """Rows that no label is learnt from; a null id counts as empty, so is none."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == HELD


def shapes(words: K.Words) -> np.ndarray:
    """A hash of each word's shape: its byte classes, repeats taken once."""
    kind = SHAPES[words.data]
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.uint64)
    opens = np.zeros(n + 1, dtype=bool)
    opens[words.start] = opens[words.end] = True
    keep = opens[:n] | np.concatenate(([True], kind[1:] != kind[:-1]))
    place = np.concatenate(([0], np.cumsum(keep)))
    up, down = K.powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(np.where(keep, K.mix(kind + K.U64(77)) * up[place[:-1]], K.U64(0)), out=total[1:])
    return K.mix((total[words.end] - total[words.start]) * down[place[words.start]] + K.U64(5))


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct feature of each text, sorted."""
    words = K.split(column)
    form = K.Words(words.data, words.offsets, words.start, words.end, shapes(words), words.row, words.first)
    pairs, at = K.windows(words, 2)
    forms, _ = K.windows(form, 2)
    triples, three = K.windows(form, 3)
    same = (words.hash[at] == words.hash[at + 1]).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    found = ((words.hash, words.row), (pairs, words.row[at]), (K.mix(form.hash + K.U64(1)), words.row), (K.mix(forms + K.U64(2) + same), words.row[at]), (K.mix(triples + K.U64(9)), words.row[three]))
    codes = np.concatenate([(r.astype(np.int64) << BITS) | (h >> K.U64(64 - BITS)).astype(np.int64) for h, r in found])
    codes = np.unique(codes)
    return codes >> BITS, codes & (BUCKETS - 1)


def sampled(docs: DataFrame, labels: DataFrame, labelled: int, chars: int) -> DataFrame:
    """(doc_id, quality, total, buckets) of at most `labelled` training rows of each class, taken by the hash of their ids; total counts the class.

    The ids are bounded, so they are broadcast and the texts do not move; one text is taken of rows repeated under an id.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    totals = {q: n for q, n in marked.groupBy("quality").count().collect()}
    pick = lambda q: marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    ids = docs.sparkSession.createDataFrame([(i, q, totals[q]) for q in (0, 1) for i, q in pick(q).collect()], "id long, quality int, total long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).where(F.coalesce(F.length("text"), F.lit(0)) <= chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.slices(batch.column(3)):
                row, bucket = indicators(batch.column(3)[lo:hi])
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo:hi] for i in range(3)), pa.array(packed, pa.binary())], ["doc_id", "quality", "total", "buckets"])

    found = rows.select("id", "quality", "total", "text").mapInArrow(run, "doc_id long, quality int, total long, buckets binary")
    return found.groupBy("doc_id", "quality", "total").agg(F.min("buckets").alias("buckets"))


@dataclass
class Model:
    """Whole-number weights and squared scales of the buckets, in units of 1 / UNIT, the bias, and the line from margins to log odds."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket's smoothed share in the good rows over that in the bad ones, in whole UNITs."""
    share = []
    for side in (good, ~good):
        held = [rows[i] for i in np.flatnonzero(side)]
        counts = SMOOTH + np.bincount(np.concatenate(held), minlength=BUCKETS)
        share.append(np.log(counts / counts.sum()))
    return np.rint((share[0] - share[1]) * UNIT) / UNIT


def descend(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, cost: float, seed: int = 0) -> np.ndarray:
    """The hinge-loss model over unit rows by dual coordinate descent: one dual variable in [0, cost] a row, met in random order, until a pass moves little."""
    weight, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    sign, rng = np.where(good, 1.0, -1.0), np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i], values[i]
            new = min(max(alpha[i] + 1.0 - sign[i] * (weight[at] @ x), 0.0), cost)
            if new != alpha[i]:
                weight[at] += (new - alpha[i]) * sign[i] * x
                moved += abs(new - alpha[i])
                alpha[i] = new
        if moved <= REST * cost * len(rows):
            break
    return weight


def calibrated(margin: np.ndarray, good: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds over margins, by Newton steps on smoothed targets; share weighs the rows to their classes' true sizes."""
    n = np.array([(~good).sum(), good.sum()])
    target = np.where(good, (n[1] + 1.0) / (n[1] + 2.0), 1.0 / (n[0] + 2.0))
    line, x = np.zeros(2), np.stack((margin, np.ones(len(margin))), axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ line, -30, 30)))
        grad = x.T @ (share * (p - target)) + 1e-6 * line
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        line = line - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(line[0]), float(line[1])


def fit(sample: DataFrame) -> Model | None:
    """A model of the bounded sample, which comes to the driver as packed buckets; None without both classes.

    One row in CALIBRATION, by its id, is kept from ratios and weights and sets the line from margins to odds; all rows do where those lack a class.
    """
    held = sorted(sample.collect())
    rows = [np.frombuffer(bytes(r.buckets), dtype=np.int32) for r in held]
    good, ids = np.array([r.quality == 1 for r in held], dtype=bool), np.array([r.doc_id for r in held], dtype=np.int64)
    if good.all() or not good.any():
        return None
    apart = K.mix(ids.view(np.uint64)) % K.U64(CALIBRATION) == 0
    if len(np.unique(good[apart])) < 2 or len(np.unique(good[~apart])) < 2:
        apart = np.zeros(len(held), dtype=bool)
    own = np.flatnonzero(~apart)
    scale = np.append(ratios([rows[i] for i in own], good[own]), 1.0)
    rows = [np.append(r, BUCKETS) for r in rows]
    values = [scale[r] / np.sqrt((scale[r] ** 2).sum()) for r in rows]
    weight = descend([rows[i] for i in own], [values[i] for i in own], good[own], COST)
    judged = np.flatnonzero(apart) if apart.any() else own
    margin = np.array([weight[rows[i]] @ values[i] for i in judged])
    size = {q: max(1, int((good[judged] == bool(q)).sum())) for q in (0, 1)}
    share = np.array([held[i].total / size[held[i].quality] for i in judged])
    slope, shift = calibrated(margin, good[judged], share / share.mean())
    return Model(np.rint(weight[:-1] * scale[:-1] * UNIT).astype(np.int64), np.rint(scale[:-1] ** 2 * UNIT).astype(np.int64), float(weight[-1]), slope, shift)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, in one pass over the texts; sums of whole numbers, so batches change nothing."""
    if model is None:
        return docs.select(id_col, held_out(id_col).alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi in K.slices(batch.column(1)):
                row, bucket = indicators(batch.column(1)[lo:hi])
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                top, square = per_row(m.weight[bucket], cuts) / UNIT + m.bias, per_row(m.square[bucket], cuts) / UNIT + 1.0
                odds = np.clip(m.slope * top / np.sqrt(square) + m.shift, -700, 700)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.round(1.0 / (1.0 + np.exp(-odds)), 9))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, score double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def apply(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    At most `labelled` rows of each label, by the hash of their ids and of at most `chars` characters, fit the model; rows held out
    give no label. Labels with nulls or other values are left out, of labels repeated for an id the bad one counts. A null
    text is scored as an empty one, by the bias alone; repeated rows are each scored, by their text; a null id is not held out and
    has no label. Without labels of both kinds every score is 0.5. Empty tables give no rows; other columns are not looked at.
    """
    return score(docs, fit(sampled(docs, labels, labelled, chars)))
