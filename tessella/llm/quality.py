"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio between trusted text and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.frames import bounded, cut, stored

BUCKETS = 1 << 16
MIN_WORDS = 50
REPEAT_PERCENT = 50
SMOOTH = 0.5
UNIT = 1 << 30
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
GAPS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def per_row(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of whole numbers between consecutive bounds."""
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def grams(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the unigrams, and of the bigrams with their first words."""
    pairs, at = K.windows(words, 2)
    return (words.hash >> K.U64(48)).astype(np.int64), (pairs >> K.U64(48)).astype(np.int64), at


def base_counts(words: K.Words, texts: list[str | None]) -> dict[str, np.ndarray]:
    data = words.data
    chars = (~K.WHITE[data]) & ((data & 0xC0) != 0x80)
    tri, at = K.windows(words, 3)
    keys = tri ^ K.mix(words.row[at].astype(np.uint64) + K.U64(1))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    repeated = np.zeros(len(words.hash), dtype=np.int64)
    repeated[at] = repeated[at + 1] = repeated[at + 2] = 1 if len(at) else 0
    dup = []
    for text in texts:
        lines = [x for x in (text or "").split("\n") if x.strip(GAPS)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(words.first), "word_chars": per_row(chars.astype(np.int64), words.offsets), "n_symbols": per_row(SYMBOLS[data], words.offsets),
        "n_dup_lines": np.asarray(dup, dtype=np.int64), "n_repeat_words": per_row(repeated, words.first),
    }


def count_grams(docs: DataFrame) -> DataFrame:
    """(trusted, bucket, n) over (text, trusted) rows: hashed unigram and bigram counts of all rows and of the trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for lo, hi in K.slices(batch.column(0)):
                words = K.split(batch.column(0)[lo:hi])
                one, two, at = grams(words)
                mine = np.asarray(batch.column(1)[lo:hi].fill_null(False))
                counts[0] += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
                if mine.any():
                    counts[1] += np.bincount(one[mine[words.row]], minlength=BUCKETS) + np.bincount(two[mine[words.row[at]]], minlength=BUCKETS)
        kind, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind == 1), pa.array(bucket.astype(np.int32)), pa.array(counts[kind, bucket])], ["trusted", "bucket", "n"])

    return docs.select("text", "trusted").mapInArrow(run, "trusted boolean, bucket int, n long").groupBy("trusted", "bucket").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket, in whole units of 1 / UNIT, so that sums of them do not depend on batches.

    Collects at most 2 * BUCKETS rows.
    """
    table = np.zeros((2, BUCKETS))
    for trusted, bucket, n in counts.collect():
        table[int(trusted), bucket] = n
    share = (table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return np.rint(UNIT * (np.log(share[1]) - np.log(share[0]))).astype(np.int64)


def score(docs: DataFrame, weight: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """The base counts and the length-normalised log-likelihood ratio of each row; texts without words score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    schema = SCHEMA.replace("doc_id long", f"{id_col} {docs.schema[id_col].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            for lo, hi in K.slices(batch.column(1)):
                column = batch.column(1)[lo:hi]
                words = K.split(column)
                out = base_counts(words, column.to_pylist())
                one, two, at = grams(words)
                total = per_row(weight[one], words.first) + per_row(weight[two], np.searchsorted(at, words.first))
                n = out["n_words"] + np.maximum(out["n_words"] - 1, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(v) for v in out.values()), pa.array(total / (np.maximum(n, 1) * float(UNIT)))], [id_col, *out, "score"])

    return docs.select(id_col, "text").mapInArrow(run, schema)


def best_threshold(scores: list[tuple[float, int]]) -> float:
    """The score that best splits labelled rows by balanced accuracy, midway in its gap, the lowest on ties; minus infinity without both labels.

    The plain definition of split(), for tests.
    """
    rows = sorted(scores)
    good, bad = sum(q == 1 for _, q in rows), sum(q == 0 for _, q in rows)
    if not good or not bad:
        return float("-inf")
    best, at, lost, caught = 1.0, float("-inf"), 0, 0
    for i, (s, q) in enumerate(rows):
        lost += q == 1
        caught += q == 0
        if i + 1 == len(rows) or rows[i + 1][0] > s:
            value = caught / bad + 1 - lost / good
            if value > best + 1e-12:
                best, at = value, (s + rows[i + 1][0]) / 2 if i + 1 < len(rows) else float(np.nextafter(s, np.inf))
    return at


def split(judged: DataFrame) -> float:
    """best_threshold of (score, good) rows of any number: distinct scores are sorted over ranges, running counts add those of the ranges before.

    One row a range reaches the driver. Values are compared as whole numbers.
    """
    each = judged.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    held = cut(each.repartitionByRange("score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id()))
    ranges = sorted(tuple(r) for r in held.groupBy("part").agg(F.sum("good"), F.sum("bad")).collect())
    good, bad = sum(r[1] for r in ranges), sum(r[2] for r in ranges)
    if not good or not bad:
        return float("-inf")
    before = [(part, sum(r[1] for r in ranges[:i]), sum(r[2] for r in ranges[:i])) for i, (part, _, _) in enumerate(ranges)]
    offsets = judged.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long")
    run = W.partitionBy("part").orderBy("score")
    lost, caught = (F.col(f"{c}_before") + F.sum(c).over(run) for c in ("good", "bad"))
    best = held.join(F.broadcast(offsets), "part").select("score", (caught * good - lost * bad).alias("value")).orderBy(F.desc("value"), "score").first()
    if best.value <= 0:
        return float("-inf")
    follow = held.where(F.col("score") > best.score).agg(F.min("score")).first()[0]
    return (best.score + follow) / 2 if follow is not None else float(np.nextafter(best.score, np.inf))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: base counts, score, base_failed and kept.

    All labelled documents name the trusted text and set the threshold, the raw multinomial counts every document; the labelled ones' texts
    are written once. A document is kept when its base rules hold and its score
    reaches the threshold. A null text counts as empty, so fails; rows repeated or with a null id are judged by their
    text alone; labels with nulls, or twice for one id, are left out or taken once (bad wins). Without labels of both
    kinds the base rules decide alone.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"), F.min("quality").alias("quality"))
    known = cut(marked.where("good = 1 OR quality = 0").select("doc_id", "good"))
    seen = stored(docs.select("doc_id", "text").join(bounded(known), "doc_id"))
    raw = count_grams(docs.select("text", F.lit(False).alias("trusted")))
    trusted = count_grams(seen.where("good = 1").select("text", F.lit(True).alias("trusted"))).where("trusted")
    weight = weights(raw.unionByName(trusted))
    scores = score(seen, weight).where(~failed()).groupBy("doc_id").agg(F.min("score").alias("score"))
    threshold = split(scores.join(bounded(known), "doc_id").select("score", "good"))
    return score(docs, weight).withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def brute(text: str | None) -> tuple[int, ...]:
    """The base columns of one text by the plain definition, for tests."""
    import re

    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    where: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {j for at in where.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)
