"""Jaccard self-join of documents over word shingles, and its connected components.

Exact copies of a shingle set form one class. Classes link when 100 * |A & B| >= percent * |A | B|. Candidates must
share a prefix token under each of three global token orders; frequent tokens come last in all of them, so
boilerplate stays out of the prefixes. The first order's prefixes make the candidates: its tokens are shuffled once, and
those of a single class end there. Near sizes and parity sketches, which bound the symmetric difference from below, sort out
pairs: one of 512 bits, and for larger sets one of at least as many bits as tokens, folded to the narrower of two. Of what is left
the other orders' prefixes are intersected, then the sets are compared.

Groups of copies do not turn into all pairs: each prefix token first pairs its classes with one leader, for some rounds.
Tokens whose classes are in one component are done. Of the rest, classes outside a token's largest component are paired
with its other classes, for one token of those that the same classes hold, and a pair under the first token that it has in common. Pairs left out are joined already, so the components are those of all links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.frames import batches, bounded, components, cut, stored

HEAVY_SHARE = 0.0001
HEAVY_ROWS = 200_000
HEAVY_BATCH = 1 << 22
#: Turns after the first; in the last one all pairs of a token meet that are still apart.
ROUNDS = 2
#: Of so many tokens of a class in the last turn, the smallest that a pair has in common is the one that it meets under.
FIRST = 64
#: In turns between, tokens of MANY classes have so many leaders.
LEADERS, MANY = 8, 64
SKETCH = 8
_ORDERS = (K.U64(0xD6E8FEB86659FD93), K.U64(0xA0761D6478BD642F))


def repeated(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that stand at least so often, sorted, and their counts. The array is sorted where it lies, so it takes no copies."""
    tokens.sort()
    early = tokens[: max(0, len(tokens) - least + 1)]
    found = np.unique(early[early == tokens[least - 1 :]])
    return found, np.searchsorted(tokens, found, "right") - np.searchsorted(tokens, found, "left")


def heavy_tokens(docs: DataFrame, k: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their ranks by count: those of HEAVY_SHARE of the texts, by counts of parts of the table that leave out rare ones.

    They only order tokens, so that neither the bound on them nor an undercount loses anything. At most HEAVY_ROWS reach the driver.
    """

    def often(tokens: np.ndarray, texts: int) -> pa.RecordBatch:
        token, n = repeated(tokens, max(3, math.ceil(HEAVY_SHARE * texts)))
        return pa.RecordBatch.from_arrays([pa.array(np.append(token.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(token), np.int64), texts))], ["token", "n", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, texts = np.empty(HEAVY_BATCH, np.uint64), 0, 0
        for batch in batches:
            for lo, hi in K.slices(batch.column(0)):
                hashes, _ = K.windows(K.split(batch.column(0)[lo:hi], lower=True), k)
                if held + len(hashes) > len(tokens):
                    yield often(tokens[:held], texts)
                    held, texts = 0, 0
                if len(hashes) > len(tokens):
                    yield often(hashes, hi - lo)
                    continue
                tokens[held : held + len(hashes)] = hashes
                held, texts = held + len(hashes), texts + hi - lo
        yield often(tokens[:held], texts)

    found = docs.select(text_col).mapInArrow(run, "token long, n long, rows long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    with batches(docs.sparkSession):
        found = cut(found)
    total = found.agg(F.sum("rows")).first()[0] or 0
    rows = found.where(F.col("n") >= max(12, HEAVY_SHARE * total)).orderBy(F.desc("n"), "token").limit(HEAVY_ROWS).select("token").collect()
    tokens = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - np.arange(len(tokens)))[order]


def parted(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set's usual tokens, and its frequent ones from the rarest on."""
    frequent, rank = heavy
    if len(frequent) and len(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hit = frequent[at] == tokens
        if hit.any():
            return tokens[~hit], tokens[hit][np.argsort(rank[at[hit]])]
    return tokens, tokens[:0]


def length(n: int, percent: int) -> int:
    """How many tokens of a set of n make its prefix."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def prefix(usual: np.ndarray, last: np.ndarray, p: int, order: np.uint64) -> np.ndarray:
    """The first p tokens: usual ones by the order, then frequent ones from the rarest on."""
    if p >= len(usual):
        return np.concatenate((usual, last[: p - len(usual)]))
    return usual[np.argpartition(usual * order, p - 1)[:p]]


def parity(at: np.ndarray, width: int) -> np.ndarray:
    """The parities of the counts of each place, packed."""
    return np.packbits((np.bincount(at.astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.int64)


def features(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of every row: its set's size and digest, parity sketches, and the usual and the frequent tokens of its prefix under the first order."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.slices(batch.column(1)):
                sizes, digests, sketches, wides, firsts, lasts = [], [], [], [], [], []
                for tokens in K.shingle_sets(K.split(batch.column(1)[lo:hi], lower=True), k):
                    p = length(len(tokens), percent)
                    sizes.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    sketches.append(parity(tokens >> K.U64(55), 64 * SKETCH))
                    wide = 1 << (len(tokens) - 1).bit_length() if len(tokens) > 64 * SKETCH else 0
                    wides.append(parity(tokens & K.U64(wide - 1), wide) if wide else sketches[-1][:0])
                    usual, last = parted(tokens, shared.value)
                    firsts.append(usual[:p].view(np.int64))
                    lasts.append(last[: max(0, p - len(usual))].view(np.int64))
                columns = [batch.column(0)[lo:hi], pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), *(K.lists(x, pa.int64()) for x in (sketches, wides, firsts, lasts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "sketch", "wide", "usual", "frequent"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n int, digest binary, sketch array<long>, wide array<long>, usual array<long>, frequent array<long>")


def compared(pairs: DataFrame, docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under the other orders too, and whose sets are similar.

    Texts move to the pairs, as they pack better than sets; copies of one end's text go with its pairs, which adaptive execution splits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.slices(batch.column(2), K.SLICE_BYTES // 2):
                texts = pa.concat_arrays([batch.column(i)[lo:hi].fill_null("") for i in (2, 3)])
                sets = list(K.shingle_sets(K.split(texts, lower=True), k))
                kept = np.zeros(hi - lo, dtype=bool)
                for i, (x, y) in enumerate(zip(sets[: hi - lo], sets[hi - lo :], strict=True)):
                    (x_usual, x_last), (y_usual, y_last) = parted(x, shared.value), parted(y, shared.value)
                    x_p, y_p = length(len(x), percent), length(len(y), percent)
                    if all(len(np.intersect1d(prefix(x_usual, x_last, x_p, order), prefix(y_usual, y_last, y_p, order), assume_unique=True)) for order in _ORDERS):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        kept[i] = 100 * both >= percent * (len(x) + len(y) - both)
                kept = pa.array(kept)
                yield pa.RecordBatch.from_arrays([batch.column(i)[lo:hi].filter(kept) for i in (0, 1)], ["a", "b"])

    ends = bounded(stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(ends, "id", "left_semi")
    one, two = texts.toDF("a", "x"), texts.toDF("b", "y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sized(percent: int, a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def alike(percent: int) -> Column:
    """What two linked sets (a_n, a_sketch, b_n, b_sketch) surely fulfil: near sizes, and a small enough sketch distance."""
    apart = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH)), F.lit(0))
    return sized(percent, "a_n", "b_n") & ((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n")))


def alike_wide(percent: int) -> Column:
    """The same for the wide sketches; true where one is missing, or more than twice as wide as the other."""
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x, y: F.when(F.size(x) == 2 * F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor)).otherwise(F.col(x))
    one, two = fold("a_wide", "b_wide"), fold("b_wide", "a_wide")
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    comparable = (F.size("a_wide") > 0) & (F.size("b_wide") > 0) & (F.size("a_wide") <= 2 * F.size("b_wide")) & (F.size("b_wide") <= 2 * F.size("a_wide"))
    return ~comparable | ((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n")))


def shared_tokens(chosen: DataFrame) -> DataFrame:
    """(token, id, n, leader) of the tokens that several classes hold; leader is one of them, (id, n).

    Usual tokens are shuffled once, for counting and for reading. Frequent ones, each of which many rows can hold, are counted
    before they move and get their leaders by a broadcast; they are at most HEAVY_ROWS.
    """
    leader = F.min(F.struct(F.xxhash64("id").alias("h"), "id", "n")).alias("leader")
    usual = chosen.select("id", "n", F.explode("usual").alias("token")).repartition("token")
    several = usual.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), leader).where("lo < hi").select("token", "leader")
    frequent = chosen.select("id", "n", F.explode("frequent").alias("token"))
    led = bounded(cut(frequent.groupBy("token").agg(leader)))
    both = usual.join(several.hint("shuffle_hash"), "token").unionByName(frequent.join(led, "token"))
    return both.select("token", "id", "n", F.struct("leader.id", "leader.n").alias("leader"))


def one_of_equals(tokens: DataFrame) -> DataFrame:
    """The rows (token, id, ...) of one token of those that the same classes hold, by two 64-bit hashes of their ids: the others' pairs are the same."""
    held = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    of_token = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), *held)
    return tokens.join(bounded(stored(of_token.groupBy("rows", "h0", "h1").agg(F.min("token").alias("token")).select("token"))), "token", "left_semi")


def with_first(tokens: DataFrame) -> DataFrame:
    """The rows (token, id, ...) with the FIRST smallest tokens of their id."""
    return tokens.join(tokens.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("token")), 1, FIRST).alias("first")), "id")


def meets_here() -> Column:
    """Whether token is the smallest of those that a pair surely has in common (a_first, b_first): so it comes out once.

    Where the smallest common token is not among both lists, they have none in common, and the pair comes out under each of its tokens.
    """
    return F.coalesce(F.array_min(F.array_intersect("a_first", "b_first")), F.col("token")) == F.col("token")


def group(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are lower-cased for A-Z. A text with fewer than k words is one shingle; one without words, or null, has none
    and links with nothing. component_id is the smallest id reachable by links, the row's own included. Rows that share
    an id count as one document with all their links; rows with a null id have a null component. Other columns
    are not read. Nothing is capped: the bound on frequent tokens only orders them.
    """
    docs = docs.select(id_col, text_col)
    heavy = heavy_tokens(docs, k, text_col)
    with batches(docs.sparkSession):
        rows = stored(features(docs, heavy, k, percent, id_col, text_col))
    own = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = stored(own.groupBy("digest").agg(F.min("doc_id").alias("id")))
    chosen = own.withColumnRenamed("doc_id", "id").join(bounded(classes.select("id")), "id", "left_semi")
    facts = chosen.select("id", "n", "sketch", "wide")
    side = lambda s: facts.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "sketch", "wide")])
    pair = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]

    def verified(pairs: DataFrame) -> DataFrame:
        near = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(alike(percent)).where(alike_wide(percent)).select("a", "b").distinct())
        if near.isEmpty():
            return near
        with batches(docs.sparkSession):
            return stored(compared(near, docs, heavy, k, percent, id_col, text_col).distinct())

    tokens = stored(shared_tokens(chosen))
    links = verified(tokens.where("id <> leader.id").where(sized(percent, "n", "leader.n")).select("id", F.col("leader.id").alias("other")).select(*pair).distinct())
    named = components(links)
    for turn in range(1, ROUNDS + 1):
        held = tokens.select("token", "id", "n").join(bounded(named), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        if turn < ROUNDS:
            each = [F.min(F.struct(F.xxhash64("id", F.lit(turn * LEADERS + i)).alias("h"), "id", "n", "comp")) for i in range(LEADERS)]
            leaders = F.slice(F.array(*each), 1, F.when(F.count(F.lit(1)) < MANY, 1).otherwise(LEADERS)).alias("leaders")
            mixed = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), leaders).where("lo < hi").select("token", F.explode("leaders").alias("leader"))
        else:
            sizes = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
            mixed = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("rows", "comp")).getField("comp").alias("largest")).where("comps > 1").select("token", "largest")
        mixed = stored(mixed)
        if mixed.isEmpty():
            break
        if turn < ROUNDS:
            led = held.join(bounded(mixed), "token")
            apart = led.where("comp <> leader.comp").where(sized(percent, "n", "leader.n")).select("id", F.col("leader.id").alias("other"))
        else:
            each = stored(with_first(one_of_equals(held.join(bounded(mixed), "token"))).join(facts.select("id", "sketch"), "id").select("token", "id", "n", "sketch", "first", "comp", (F.col("comp") != F.col("largest")).alias("minor")))
            one = each.where("minor").select("token", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "sketch", "first", "comp")])
            two = each.select(F.col("token").alias("token2"), *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "sketch", "first", "comp")], "minor")
            met = one.join(two, (F.col("token") == F.col("token2")) & (F.col("a_comp") != F.col("b_comp")) & (~F.col("minor") | (F.col("a_id") < F.col("b_id"))) & alike(percent) & meets_here())
            apart = met.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"))
        links = links.union(verified(apart.select(*pair).distinct()))
        named = components(links)
    of_class = classes.join(bounded(named), "id", "left").select("digest", F.coalesce("component", "id").alias("comp"))
    joined = own.select("doc_id", "n", "digest").join(bounded(stored(of_class)), "digest").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("comp").alias("component_id"))
    alone = rows.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumnRenamed("doc_id", id_col)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a smaller id of their component stands for. Rows under one id, or none, stay as they are."""
    gone = cut(group(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS t FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p WHERE 100 * o >= 85 * (na + nb - o) UNION ALL SELECT b, a FROM p WHERE 100 * o >= 85 * (na + nb - o)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a
)
SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, CAST(min(r.y) AS BIGINT) AS component_id
FROM s JOIN r ON s.doc_id = r.x GROUP BY s.doc_id
"""
