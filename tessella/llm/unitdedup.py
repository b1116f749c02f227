"""Exact dedup of lines and of the phrases of long lines, across all documents.

Units are lines; a line is cut further after every word whose hash is 0 modulo ANCHOR, so that the same passage falls
into the same units wherever it stands in a line. Lines and units are normalised (A-Z to lower case, white space to one
space) and digested, digests are grouped globally, the occurrence of the least (document, position) stays and the rest are
repeats. Repeated whole lines are removed whatever their length; other runs of neighbouring repeats are if they weigh
`least` words, two characters of a script without spaces weighing one. Runs are given by their offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.frames import stored

ANCHOR = 6
LEAST = 20
#: Keeps the digests of whole lines apart from those of units.
_LINE = K.U64(0x9E3779B97F4A7C15)
_STEP, _BACK = K.U64(0xD1342543DE82EF95), K.U64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def digests(words: K.Words, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The digests of stretches of words."""
    n = len(words.hash)
    up = np.full(n, _STEP, dtype=np.uint64)
    down = np.full(n, _BACK, dtype=np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words.hash * np.cumprod(up), out=total[1:])
    return K.mix((total[stop] - total[start]) * np.cumprod(down)[start] + (stop - start).astype(np.uint64))


def line_ends(words: K.Words) -> np.ndarray:
    """Of each word, whether it is its line's last."""
    newline = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.cumsum(words.data == 10, out=newline[1:])
    ends = np.ones(len(words.hash), dtype=bool)
    ends[:-1] = (words.row[1:] != words.row[:-1]) | (newline[words.start[1:]] > newline[words.end[:-1]])
    return ends


def cut_units(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one word of every unit, and its digest."""
    if len(words.hash) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    ends = line_ends(words)
    ends[:-1] |= words.hash[:-1] % K.U64(ANCHOR) == 0
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate(([0], stop[:-1]))
    return start, stop, digests(words, start, stop).view(np.int64)


def weights(words: K.Words, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The words of stretches, or half their characters of scripts without spaces if those are more.

    The scripts are told by their bytes in UTF-8: Thai and Lao, Myanmar, Khmer, kana and Han.
    """
    lead, second = words.data, np.append(words.data[1:], np.uint8(0))
    dense = ((lead >= 0xE3) & (lead <= 0xE9)) | ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)) | ((lead == 0xE1) & np.isin(second, (0x80, 0x81, 0x82, 0x9E, 0x9F)))
    before = np.concatenate(([0], np.cumsum(dense)))
    return np.maximum(stop - start, (before[words.end[stop - 1]] - before[words.start[start]]) // 2)


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, digest, start, end, n_words, weight, held): units with their places in code points, end exclusive.

    A whole line has a row more, with its first unit, the number of units it holds in `held`, and no place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.slices(batch.column(1)):
                words = K.split(batch.column(1)[lo:hi], lower=True)
                start, stop, digest = cut_units(words)
                if len(start) == 0:
                    continue
                row = words.row[start]
                first = np.searchsorted(row, np.arange(hi - lo))
                points = np.zeros(len(words.data) + 1, dtype=np.int64)
                np.cumsum((words.data & 0xC0) != 0x80, out=points[1:])
                base = points[words.offsets[row]]
                begin, end = points[words.start[start]] - base, points[words.end[stop - 1]] - base
                last = np.flatnonzero(line_ends(words)[stop - 1])
                head = np.concatenate(([0], last[:-1] + 1))
                whole = K.mix(digests(words, start[head], stop[last]) ^ _LINE).view(np.int64)
                place, none = (np.arange(len(row)) - first[row]).astype(np.int32), np.zeros(len(head), np.int32)
                both = lambda a, b: pa.array(np.concatenate((a, b)).astype(np.int32))
                ids = batch.column(0)[lo:hi].take(pa.array(np.concatenate((row, row[head]))))
                columns = [ids, both(place, place[head]), pa.array(np.concatenate((digest, whole))), both(begin, none), both(end, none), both(stop - start, none), both(weights(words, start, stop), none), both(np.zeros(len(row)), last - head + 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "unit", "digest", "start", "end", "n_words", "weight", "held"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return picked.mapInArrow(run, "doc_id long, unit int, digest long, start int, end int, n_words int, weight int, held int")


def removals(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each removed run: (doc_id, start, end, n_words, first_doc_id), offsets in code points of the original text.

    first_doc_id is the least document that keeps a part of the run; it can be the document itself. Null and empty texts have no
    units; rows with a null id are ignored. Rows repeated under one id are ranked as one document, so none of them is
    the other's repeat. Only digests and places are moved, never text. Digests are counted before they move; the repeated ones are
    written and meet the places in a join of two plain shuffles, whose hot digests adaptive execution splits.
    """
    placed = units(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    firsts = placed.groupBy("digest").agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.max(F.struct("doc_id", "unit")).alias("last")).where("first <> last").select("digest", "first")
    again = placed.join(stored(firsts), "digest").where("doc_id <> first.doc_id OR unit <> first.unit").select("doc_id", "unit", "held", "start", "end", "n_words", "weight", F.col("first.doc_id").alias("first_doc_id"))
    each = again.withColumn("unit", F.explode(F.sequence("unit", F.col("unit") + F.greatest("held", F.lit(1)) - 1)))
    own = [F.min(F.when(F.col("held") == 0, F.col(c))).alias(c) for c in ("start", "end", "n_words", "weight")]
    each = each.groupBy("doc_id", "unit").agg(*own, F.min("first_doc_id").alias("first_doc_id"), (F.max("held") > 0).alias("whole")).where("start IS NOT NULL")
    island = F.col("unit") - F.row_number().over(W.partitionBy("doc_id").orderBy("unit"))
    heavy = each.withColumn("island", island).withColumn("total", F.sum("weight").over(W.partitionBy("doc_id", "island")))
    runs = heavy.where((F.col("total") >= least) | F.col("whole")).withColumn("island", island).groupBy("doc_id", "island")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
    return runs.select("doc_id", "start", "end", "n_words", "first_doc_id")


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with those runs cut out of their texts; other columns and documents stay as they are."""
    spans = found.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    joined = docs.join(spans, docs[id_col] == F.col("__id"), "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    kept = F.aggregate("__spans", start, lambda s, x: F.struct(F.concat(s["text"], F.substring(F.col(text_col), s["at"] + 1, x["start"] - s["at"])).alias("text"), x["end"].alias("at")), lambda s: F.concat(s["text"], F.substring(F.col(text_col), s["at"] + 1, F.length(text_col) - s["at"])))
    return joined.select(*[F.when(F.col("__spans").isNotNull(), kept).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])


def brute(texts: dict[int, str | None], least: int = LEAST) -> dict[int, list[tuple[int, int]]]:
    """Runs by the plain definition, for tests; units come from the same cut."""
    seen: set[tuple] = set()
    seen_lines: set[tuple] = set()
    out: dict[int, list[tuple[int, int]]] = {}
    for doc in sorted(texts):
        text = texts[doc] or ""
        data, words = text.encode(), K.split(pa.array([text]), lower=True)
        found, line = [], []
        ends = line_ends(words)
        for a, b, _ in zip(*cut_units(words), strict=True):
            key = tuple(bytes(data[words.start[i] : words.end[i]]).lower() for i in range(a, b))
            plain = data[words.start[a] : words.end[b - 1]].decode()
            dense = sum(0x0E00 <= ord(c) < 0x0F00 or 0x1000 <= ord(c) < 0x10C0 or 0x1780 <= ord(c) < 0x1800 or 0x3000 <= ord(c) < 0xA000 for c in plain)
            line.append([len(data[: words.start[a]].decode()), len(data[: words.end[b - 1]].decode()), max(b - a, dense // 2), key in seen, False, key])
            seen.add(key)
            if ends[b - 1]:
                whole = sum((u[5] for u in line), ())
                for u in line:
                    u[4] = whole in seen_lines
                seen_lines.add(whole)
                found, line = found + line, []
        for repeated, run in groupby(found, lambda u: u[3]):
            run = list(run)
            enough = sum(u[2] for u in run) >= least
            for goes, part in groupby(run, lambda u: enough or u[4]):  # noqa: B023
                part = list(part)
                if repeated and goes:
                    out.setdefault(doc, []).append((part[0][0], part[-1][1]))
    return out
