"""Language identification of whole texts, with spans of mixed-language text.

A model holds, for every learned language, log-probabilities of hashed byte n-grams inside words and the scripts that its
training words use. A word's script narrows the candidate languages; its score under each is the sum of its
n-grams' log-probabilities. Viterbi over the words of a text, with a penalty for switching language, labels spans;
the language that holds most letters of a text is its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import kernels as K
from tessella.llm.frames import free

BUCKETS = 1 << 15
SAMPLE = 20_000
#: Bytes of text seen at once: half of a usual slice, as every byte has several n-grams.
SLICE = K.SLICE_BYTES // 2
SWITCH = 12.0
FOREIGN = 1e-3
LEAST = 0.5
#: First code points of script ranges, up to the next; 0 is common to all scripts.
SCRIPTS = {
    0x0000: 1, 0x0370: 2, 0x0400: 3, 0x0530: 4, 0x0590: 5, 0x0600: 6, 0x0900: 7, 0x0E00: 8, 0x1100: 9, 0x1200: 0,
    0x1E00: 1, 0x1F00: 2, 0x2000: 0, 0x3040: 10, 0x3130: 9, 0x3190: 0, 0x31F0: 10, 0x3200: 0, 0x3400: 11, 0xA000: 0,
    0xAC00: 9, 0xD800: 0, 0xF900: 11, 0xFB00: 0,
}
N_SCRIPTS = 12
_STARTS = np.array(sorted(SCRIPTS))
_KINDS = np.array([SCRIPTS[s] for s in sorted(SCRIPTS)])
LETTER = regex.compile(r"\p{L}").search
#: Bytes that count as letters: ASCII letters, folded, and all of multi-byte characters.
FOLD = np.zeros(256, dtype=np.uint64)
FOLD[97:123] = np.arange(1, 27)
FOLD[65:91] = np.arange(1, 27)
FOLD[128:] = np.arange(27, 155)


@dataclass
class Grams:
    """Words of a slice with letters, the hashed n-grams of their bytes and each n-gram's word."""

    words: K.Words
    buckets: np.ndarray
    owner: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def grams(column: pa.Array) -> Grams:
    """n-grams of one to four letters, the word's ends included, of every word."""
    words = K.split(column)
    data = words.data
    fold = FOLD[data]
    n = len(data)
    buckets, owner = [], []
    if n:
        letter = fold > 0
        place = np.searchsorted(words.start, np.arange(n), side="right") - 1
        pad = np.zeros(n + 4, dtype=np.uint64)
        inside = np.full(n + 4, -1, dtype=np.int64)
        pad[2 : n + 2] = fold
        inside[2 : n + 2] = np.where(letter, place, -1)
        here = inside[2 : n + 2]
        before = np.where(inside[1 : n + 1] == here, pad[1 : n + 1], K.U64(0))
        earlier = np.where((before > 0) & (inside[0:n] == here), pad[0:n], K.U64(0))
        after = np.where(inside[3 : n + 3] == here, pad[3 : n + 3], K.U64(0))
        at = np.flatnonzero(letter)
        codes = (before << K.U64(8)) | fold
        for kind, code in ((1, codes), (2, (codes << K.U64(8)) | after), (3, (earlier << K.U64(24)) | (codes << K.U64(8)) | after)):
            buckets.append((K.mix(code[at] * K.U64(4) + K.U64(kind)) >> K.U64(49)).astype(np.int32))
            owner.append(place[at])
        letters = np.bincount(place[at][(data[at] & 0xC0) != 0x80], minlength=len(words.start))
    else:
        letters = np.zeros(0, np.int64)
    return Grams(words, np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(owner) if owner else np.zeros(0, np.int64), letters, scripts(words))


def scripts(words: K.Words) -> np.ndarray:
    """The script of each word: that of its first character beyond ASCII and the Latin ranges, else Latin (1)."""
    data, n = words.data, len(words.data)
    out = np.ones(len(words.start), dtype=np.int64)
    lead = np.flatnonzero(data >= 0xCD)
    if len(lead) == 0:
        return out
    b = [data[np.minimum(lead + i, n - 1)].astype(np.int64) & 0x3F for i in range(3)]
    first = data[lead].astype(np.int64)
    code = np.where(first < 0xE0, ((first & 0x1F) << 6) | b[1], np.where(first < 0xF0, ((first & 0x0F) << 12) | (b[1] << 6) | b[2], 0x20000))
    kind = np.where(code >= 0x10000, 0, _KINDS[np.searchsorted(_STARTS, code, side="right") - 1])
    use = kind > 1
    place = np.searchsorted(words.start, lead[use], side="right") - 1
    out[place[::-1]] = kind[use][::-1]
    return out


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray
    scripts: np.ndarray


def learn(docs: DataFrame, limit: int = SAMPLE) -> Model:
    """Counts of n-grams and scripts by language over a sample of about `limit` labelled texts, chosen by the hash of their ids.

    Only documents whose crc32(id) mod 5 is not 0 are read. At most BUCKETS + N_SCRIPTS rows a language reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = min(1.0, limit / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in K.slices(batch.column(1), SLICE):
                g = grams(batch.column(1)[lo:hi])
                langs = np.array(batch.column(0)[lo:hi].to_pylist(), dtype=object)
                names, code = np.unique(langs.astype(str), return_inverse=True)
                by_word = code[g.words.row] if len(g.words.row) else np.zeros(0, np.int64)
                for i, name in enumerate(names):
                    own = counts.setdefault(str(name), np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64))
                    own[:BUCKETS] += np.bincount(g.buckets[by_word[g.owner] == i], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(g.script[(by_word == i) & (g.letters > 0)], minlength=N_SCRIPTS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = known.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r[0] for r in rows})
    table = np.zeros((len(languages), BUCKETS + N_SCRIPTS))
    for lang, bucket, n in rows:
        table[languages.index(lang), bucket] = n
    grams_, used = table[:, :BUCKETS], table[:, BUCKETS:]
    logs = np.log((grams_ + 0.5) / (grams_.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return Model(languages, (logs - logs.mean(axis=0)).astype(np.float32) if len(languages) else logs, used >= FOREIGN * np.maximum(1, used.sum(axis=1, keepdims=True)))


def word_scores(g: Grams, model: Model) -> np.ndarray:
    """Score of each word under each language: mean over its n-gram orders, candidates narrowed by script."""
    out = np.empty((len(g.words.start), len(model.languages)))
    for i in range(len(model.languages)):
        out[:, i] = np.bincount(g.owner, weights=model.logs[i][g.buckets], minlength=len(out)) / 3
    fits = model.scripts[:, g.script].T
    none = ~fits.any(axis=1)
    fits[none] = True
    out[~fits] = -50.0
    out[g.letters == 0] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. Texts of a slice advance side by side; first[r]:first[r + 1] are the words of text r."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    n = scores.shape[1]
    path = np.zeros(len(scores), dtype=np.int8 if n < 128 else np.int32)
    if n < 2 or longest == 0:
        return path
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    start = first[:-1][order]
    state = np.zeros((len(order), n))
    back = np.zeros(scores.shape, dtype=bool)
    came = np.zeros(len(scores), dtype=path.dtype)
    for t in range(longest):
        a = active[t]
        at = start[:a] + t
        now = state[:a]
        top = now.argmax(axis=1)
        best = now[np.arange(a), top] - switch
        stay = now >= best[:, None]
        back[at] = ~stay
        came[at] = top
        state[:a] = np.where(stay, now, best[:, None]) + scores[at]
    label = state.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        now = label[:a]
        path[at] = now
        label[:a] = np.where(back[at, now], came[at], now)
    return path


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = False, id_col: str = "doc_id") -> DataFrame:
    """One row a document: lang_pred and its score, the share of the text's letters that Viterbi gives to it.

    `und` with score 0 for a null text, one without letters or an empty model. With spans also `spans`, the runs of one
    language as (start word, end word, lang). Ties go to the first language in name order. Repeated rows are judged
    alike; lang, source and the id are not read. One pass without a shuffle; very long texts cost time in proportion.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(id_col, "text").mapInArrow(labeller(docs, model, switch, [0], 1, spans, [id_col, "lang_pred", "score"]), schema)


def labeller(docs: DataFrame, model: Model, switch: float, kept: list[int], text: int, spans: bool, names: list[str]):
    """A function over record batches: the kept columns, the label and score of the text column, and spans if wanted, under names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.languages)
        for batch in batches:
            for lo, hi in K.slices(batch.column(text), SLICE):
                column = batch.column(text)[lo:hi]
                g = grams(column)
                first = g.words.first
                path = viterbi(word_scores(g, model), first, switch) if n else np.zeros(len(g.words.start), np.int8)
                share = np.zeros((hi - lo, max(1, n)))
                np.add.at(share, (g.words.row, path), g.letters)
                label, total = share.argmax(axis=1), share.sum(axis=1)
                has = [n > 0 and t is not None and LETTER(t) is not None for t in column.to_pylist()]
                labels = [model.languages[label[r]] if has[r] else "und" for r in range(hi - lo)]
                score = [float(share[r, label[r]] / total[r]) if has[r] and total[r] else 0.0 for r in range(hi - lo)]
                columns = [*(batch.column(i)[lo:hi] for i in kept), pa.array(labels, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    runs = []
                    for r in range(hi - lo):
                        own = path[first[r] : first[r + 1]]
                        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) and n else []
                        runs.append([{"start": a, "end": b, "lang": model.languages[own[a]]} for a, b in zip(edges, edges[1:], strict=False)])
                    columns.append(pa.array(runs, pa.list_(kind)))
                yield pa.RecordBatch.from_arrays(columns, [*names, *["spans"] * spans])

    return run


def accept(docs: DataFrame, model: Model, least: float = LEAST, switch: float = SWITCH) -> DataFrame:
    """The documents, with all their columns, whose language is known: not `und`, and one language holds `least` of the letters.

    Rows pass through the labeller once. Null and empty texts are `und`, so they go; repeated rows are judged alike; a null id or
    lang changes nothing. Columns may have any name.
    """
    lang, score = free(docs, "lang_found"), free(docs, "score_found")
    names = [*docs.columns, lang, score]
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    known = docs.mapInArrow(labeller(docs, model, switch, list(range(len(docs.columns))), docs.columns.index("text"), False, names), schema)
    return known.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)


def identify(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Learn from the documents whose crc32(id) mod 5 is not 0, then predict all: doc_id, held_out, lang_pred, score."""
    return predict(docs, learn(docs, limit)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
