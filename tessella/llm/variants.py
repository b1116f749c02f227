"""Spelling variants: words one edit apart, found by deletion keys, and the frequent word that each rare one stands for.

Words of one edit share a string: both without the same position (a replaced code point), or the shorter word and the longer without a
position. Keys of all those strings come from prefix and suffix polynomial hashes in numpy, one product a position. Spark deals the keys by
their leading bits and sorts them; equal neighbours become candidates, which are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.frames import stored
from tessella.llm.resampling import CRC_MACRO, LOWER, UPPER, crc_sql

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
SLIP = 199
#: Bits of a key that name its radix class.
RADIX = 12
REPLACED, DELETED = 0, 1


def without(word: Column, at: Column) -> Column:
    """A word without its code point at a 0-based place."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(id, word, n): the words of all texts after the planted slips, with their counts; ids are the table's own.

    Runs too short to give a word are left out by the pattern: it takes a maximal run whole or not at all. Counts are made in each task first.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    slipped = F.when(h % slip == 0, without(F.col("run"), (h % F.length("run")).cast("int"))).otherwise(F.col("run"))
    counted = each.select(slipped.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))
    return stored(kept.select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words without each position, and of the whole words at position -1: (index of the word, key, position, first of a run of equal code points)."""
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - start[owner]
    up, down = K.powers(int(sizes.max(initial=0)))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(K.mix(codes + K.U64(1)) * up[place], out=total[1:])
    prefix = total[:-1] - total[start[owner]]
    suffix = total[start[owner + 1]] - total[1:]
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    whole = total[start[1:]] - total[start[:-1]]
    key = K.mix(np.concatenate((whole, prefix + suffix * down[1])))
    return np.concatenate((np.arange(len(words)), owner)), key.view(np.int64), np.concatenate((np.full(len(words), -1), place)).astype(np.int32), np.concatenate((np.ones(len(words), dtype=bool), first))


def keyed(words: DataFrame) -> DataFrame:
    """(radix, key, pos, id, first) of all deletions of (id, word) rows, and of the whole words at pos -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, hi in K.slices(batch.column(1)):
                index, key, pos, first = deletion_keys(batch.column(1)[lo:hi].to_pylist())
                radix = (key.view(np.uint64) >> K.U64(64 - RADIX)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(radix), pa.array(key), pa.array(pos), pa.array(ids[lo:hi][index]), pa.array(first)], ["radix", "key", "pos", "id", "first"])

    return words.select("id", "word").mapInArrow(run, "radix int, key long, pos int, id long, first boolean")


def matched(key: np.ndarray, pos: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and position: which share key and position with another, and which share the key of a whole word, that word's row included."""
    if len(key) == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    part = np.concatenate(([True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])))
    run, sub = np.cumsum(fresh) - 1, np.cumsum(part) - 1
    whole = pos == -1
    replaced = ~whole & (np.bincount(sub)[sub] > 1)
    owned = np.bincount(run, weights=whole)[run] > 0
    longer = np.bincount(run, weights=~whole & first)[run] > 0
    return replaced, owned & longer & (whole | first)


def candidates(words: DataFrame) -> DataFrame:
    """(kind, pos, id): rows of words that share a deletion key with another word; lone keys end in the task that sorts them.

    Keys are dealt by their radix class and sorted. A task holds one Arrow batch and the last key's rows, of which there are at
    most as many as ways to write one letter into one string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "pos", "id", "first"]
        held = {n: np.zeros(0, kind) for n, kind in zip(names, (np.int64, np.int32, np.int64, bool), strict=True)}

        def done(rows: dict) -> pa.RecordBatch:
            replaced, deleted = matched(rows["key"], rows["pos"], rows["first"])
            kind = np.concatenate((np.full(replaced.sum(), REPLACED), np.full(deleted.sum(), DELETED))).astype(np.int32)
            columns = [np.concatenate((rows[n][replaced], rows[n][deleted])) for n in ("pos", "id")]
            return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], ["kind", "pos", "id"])

        for batch in batches:
            rows = {n: np.concatenate((held[n], batch.column(i).to_numpy(zero_copy_only=False))) for i, n in enumerate(names)}
            last = int(np.searchsorted(rows["key"], rows["key"][-1])) if len(rows["key"]) else 0
            held = {n: v[last:] for n, v in rows.items()}
            yield done({n: v[:last] for n, v in rows.items()})
        yield done(held)

    dealt = keyed(words).repartition("radix").sortWithinPartitions("key", "pos")
    return dealt.select("key", "pos", "id", "first").mapInArrow(run, "kind int, pos int, id long")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are one edit away, and the largest of them as (-n, word, id), ties to the smaller word.

    Candidates meet by the shared string itself, so equal hashes of unequal strings part here. A group's members are counted and
    their two largest found by windows, without pairs: a member's best neighbour is the largest other one. A deletion group is one whole word and the
    words one longer; only the whole word is near to all.
    """
    found = candidates(words).join(words, "id")
    shared = F.when(F.col("pos") < 0, F.col("word")).otherwise(without(F.col("word"), F.col("pos")))
    rows = found.select("id", "word", "n", "kind", "pos", shared.alias("shared"), F.when(F.col("kind") == REPLACED, F.col("pos")).otherwise(-1).alias("at"))
    group = W.partitionBy("kind", "at", "shared")
    order = group.orderBy(F.asc(F.col("pos") >= 0), F.desc("n"), "word")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("n"), "word", "id")
    seen = rows.select(
        "id", "kind", F.count(F.lit(1)).over(group).alias("size"), F.row_number().over(order).alias("place"), F.first("pos").over(whole).alias("head"),
        F.first(one).over(whole).alias("a"), F.nth_value(one, 2).over(whole).alias("b"),
    ).where((F.col("size") > 1) & ((F.col("kind") == REPLACED) | (F.col("head") < 0)))
    near = F.when((F.col("kind") == REPLACED) | (F.col("place") == 1), F.col("size") - 1).otherwise(1)
    return seen.groupBy("id").agg(F.sum(near).alias("n_near"), F.min(F.when(F.col("place") == 1, F.col("b")).otherwise(F.col("a"))).alias("best"))


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of (id, up): up followed to its end by doubling. Counts grow by a factor at each step up, so chains are short and have no cycle."""
    held = stored(parents.select("id", F.col("up").alias("root")))
    while True:
        above = held.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        held = stored(held.join(above, "root", "left").select("id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        if held.where("moved").limit(1).count() == 0:
            return held.select("id", "root")
        held = held.select("id", "root")


def group(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word of largest n, if that is at least `times` its own; root is the end of the chain of forms. Null and
    empty texts have no words; a null doc_id counts as an empty one in the slips; rows repeated count again. Words of any length take part, at
    a key of 25 bytes a letter. Other columns are not looked at. An empty table gives no rows.
    """
    words = vocabulary(docs, least_length, least_count, slip)
    near = words.join(neighbours(words), "id", "left")
    form = -F.col("best.n") >= times * F.col("n")
    known = stored(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.id")).alias("up"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n")))
    ends = roots(known.where("up IS NOT NULL").select("id", "up")).join(words.select(F.col("id").alias("root"), F.col("word").alias("end")), "root").select("id", "end")
    return known.join(ends, "id", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""WITH RECURSIVE {CRC_MACRO},
x AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
y AS (SELECT doc_id, run, count(*) AS c FROM x WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT run, c, {crc_sql("doc_id || ':' || run")} AS h FROM y, crc_table),
s AS (SELECT c, CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM s WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT DISTINCT word, n, part FROM d),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION ALL SELECT e.word, v.word, v.n FROM e JOIN v ON e.part = v.word UNION ALL SELECT v.word, e.word, e.n FROM e JOIN v ON e.part = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN other END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) t USING (word)"""
