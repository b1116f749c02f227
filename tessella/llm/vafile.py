"""Exact top-k inner-product search by a vector-approximation file.

The file holds one byte a dimension for each vector: the cell of its component between thresholds that are quantiles of a
sample. It is written once. A scan of the file alone bounds each query's score with each vector from both sides; the kth
best lower bound over all blocks is a score that k vectors surely reach, so only vectors whose upper bound is not below it
stay candidates. Exact vectors are then read in the order of the bounds: first each query's FIRST candidates, whose kth exact score is the
new bar, then those whose upper bound still reaches it. Nothing below the bar can be a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.frames import stored

CELLS = 256
#: Vectors whose components set the thresholds; they change the bounds' width, never the result.
SAMPLE = 20_000
#: Bytes of approximations in a block. Queries are copied to every block, and every block returns at least k rows a query, so blocks are as large as a task can hold.
BLOCK = 1 << 25
QUERIES = 16_384
FIRST = 2
#: Scores are whole numbers of 64 bits: no component is larger than this over the root of the dimension.
LARGEST = 1 << 31
#: What sums of doubles can be off by, as a share of the summands.
ROUNDING = 1e-12
_CHUNK, _ROWS = 256, 8192


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as longs; vectors that are null, empty or hold a null, non-finite or too large component go.

    Too large is what could take a score beyond 64 bits: components of LARGEST / sqrt(dimension) or more after scaling.
    """
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    held = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(~bad & (F.size(vector_col) > 0))
    large = F.exists(vector_col, lambda x: F.abs(x.cast("double")) * scale >= LARGEST / F.sqrt(F.size(vector_col).cast("double")))
    return held.where(~large).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def thresholds(exact: DataFrame, total: int) -> dict[int, list[tuple[np.ndarray, int, int]]]:
    """Of each dimension d of the vectors of each length: up to CELLS - 1 thresholds, and the least and largest component of all vectors."""

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                x = np.stack(own["v"].to_numpy())
                yield pd.DataFrame({"dim": dim, "d": np.arange(dim), "lo": x.min(axis=0), "hi": x.max(axis=0)})

    span = exact.select("dim", "v").mapInPandas(ends, "dim int, d int, lo long, hi long").groupBy("dim", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    share = min(1.0, SAMPLE / max(1, total))
    some = exact.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(share * (1 << 40))).select("dim", "v").limit(2 * SAMPLE).toPandas()
    out: dict[int, list] = {}
    for dim, d, lo, hi in sorted(map(tuple, span)):
        own = some.loc[some["dim"] == dim, "v"]
        column = np.array([v[d] for v in own], dtype=np.int64) if len(own) else np.array([lo, hi])
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, CELLS + 1)[1:-1], method="nearest")).astype(np.int64)
        out.setdefault(dim, []).append((cuts, lo, hi))
    return out


def approximations(exact: DataFrame, cuts: dict[int, list[tuple[np.ndarray, int, int]]]) -> DataFrame:
    """(vec_id, dim, cells): one byte a dimension; component x lies in cell c when cuts[c - 1] <= x < cuts[c]."""
    shared = exact.sparkSession.sparkContext.broadcast(cuts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                x = np.stack(own["v"].to_numpy())
                cells = np.stack([np.searchsorted(shared.value[dim][d][0], x[:, d], side="right") for d in range(dim)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "dim": np.int32(dim), "cells": [c.tobytes() for c in cells]})

    return exact.mapInPandas(run, "vec_id long, dim int, cells binary")


def bounds(block: pd.DataFrame, queries: pd.DataFrame, cuts: list[tuple[np.ndarray, int, int]], k: int) -> pd.DataFrame:
    """The vectors of a block that can be among a query's best k of it, with the bounds of their scores: (query_id, vec_id, least, most).

    The block is met in parts of _ROWS vectors; the kth best lower bound so far is carried from part to part, so only the first part is looked at without one.
    """
    cells = np.frombuffer(b"".join(block["cells"]), dtype=np.uint8).reshape(len(block), -1)
    low = [np.concatenate(([lo], at)).astype(np.float64) for at, lo, _ in cuts]
    high = [np.concatenate((at - 1, [hi])).astype(np.float64) for at, _, hi in cuts]
    ids, asked = block["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    vectors = np.stack(queries["v"].to_numpy()).astype(np.float64)
    best, parts = np.full((len(asked), k), -np.inf), []
    for start in range(0, len(ids), _ROWS):
        part, own_part = cells[start : start + _ROWS], ids[start : start + _ROWS]
        middle = np.stack([((low[d] + high[d]) / 2)[part[:, d]] for d in range(len(cuts))], axis=1)
        half = np.stack([((high[d] - low[d]) / 2)[part[:, d]] for d in range(len(cuts))], axis=1)
        half += ROUNDING * (np.abs(middle) + half)
        for lo in range(0, len(asked), _CHUNK):
            q, own_ids = vectors[lo : lo + _CHUNK], asked[lo : lo + _CHUNK]
            centre, reach = q @ middle.T, np.abs(q) @ half.T
            least, most = centre - reach, centre + reach
            own = own_ids[:, None] == own_part[None, :]
            least[own] = -np.inf
            n = least.shape[1]
            top = least if n <= k else np.partition(least, n - k, axis=1)[:, n - k :]
            best[lo : lo + _CHUNK] = np.sort(np.concatenate((best[lo : lo + _CHUNK], top), axis=1), axis=1)[:, -k:]
            at, to = np.nonzero((most >= best[lo : lo + _CHUNK, :1]) & ~own)
            parts.append((lo + at, own_part[to], least[at, to], most[at, to]))
    at, to, least, most = (np.concatenate(x) for x in zip(*parts, strict=True))
    kept = most >= best[at, 0]
    return pd.DataFrame({"query_id": asked[at[kept]], "vec_id": to[kept], "least": least[kept], "most": most[kept]})


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Each query's k best candidates: (query_id, rank, vec_id, score), ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all other rows of the same dimension. Blocks of about
    `block` bytes of approximations, and at least one for each core, meet groups of QUERIES queries; blocks depend on ids alone, so equal vectors spread evenly. A query with
    fewer than k candidates returns all of them. Rows repeated under one id count once (the smallest vector). Null or
    non-finite vectors, those with components too large for scores of 64 bits, and null ids take no part. An empty table gives no rows; other columns are not read.
    """
    exact = stored(quantise(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    total = max(1, exact.count())
    cuts = thresholds(exact, total)
    file = stored(approximations(exact, cuts))
    size = exact.agg(F.sum("dim")).first()[0] or 0
    blocks, groups = max(-(-size // block), vectors.sparkSession.sparkContext.defaultParallelism), -(-total // (every * QUERIES))
    spread = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = file.withColumn("c", spread(blocks, 1)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = exact.where(F.col("vec_id") % every == 0)
    asked = queries.withColumn("g", spread(groups, 2)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)

    def meet(key: tuple, block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if len(block) == 0 or len(own) == 0:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "least": np.zeros(0), "most": np.zeros(0)})
        return bounds(block, own, shared.value[key[0]], k)

    scanned = stored(each.groupBy("dim", "c", "g").cogroup(asked.groupBy("dim", "c", "g")).applyInPandas(meet, "query_id long, vec_id long, least double, most double"))
    kth = lambda df, column: df.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(column), "vec_id"))).where(F.col("r") == k).select("query_id", F.col(column).alias("bar"))
    open_ = scanned.join(kth(scanned, "least"), "query_id", "left").where("bar IS NULL OR most >= bar").select("query_id", "vec_id", "most")
    order = W.partitionBy("query_id").orderBy(F.desc("most"), "vec_id")
    open_ = stored(open_.withColumn("turn", F.row_number().over(order)))

    def read(pairs: DataFrame) -> DataFrame:
        asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        return pairs.select("query_id", "vec_id").join(exact.select("vec_id", "v"), "vec_id").join(asked, "query_id").select("query_id", "vec_id", score.alias("score"))

    first = stored(read(open_.where(F.col("turn") <= FIRST * k)))
    rest = open_.where(F.col("turn") > FIRST * k).join(kth(first, "score"), "query_id").where("most >= bar")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.union(read(rest)).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute(ids: list[int], vectors: list, k: int = 5, every: int = 50, scale: int = 256) -> list[tuple]:
    """The definition on the driver, for tests."""
    rows = {i: np.floor(np.asarray(v, dtype=np.float64) * scale).astype(np.int64) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in rows.items():
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in rows.items() if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
