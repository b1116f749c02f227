"""What keeps joins and tasks of the corpus operators in proportion to their input, and that it changes no result."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import htmltext, linededup, ngramjoin


def test_html_windows_are_told_apart_without_sorting_pairs():
    dice = np.random.default_rng(3)
    for n in (0, 1, 500):
        keys, row = dice.integers(0, 40, n).astype(np.uint64), np.sort(dice.integers(0, 9, n))
        key, rows = htmltext.once(keys, row)
        assert list(zip(key.tolist(), rows.tolist(), strict=True)) == sorted(set(zip(keys.tolist(), row.tolist(), strict=True)))
    sizes = [0, 3, 4, 0, 1, 2]
    hit = dice.random(10) < 0.5
    assert htmltext.mostly(hit, sizes) == [bool(n) and bool(x.mean() >= htmltext.COVERED) for n, x in zip(sizes, np.split(hit, np.cumsum(sizes)), strict=False)]


def test_jaccard_pairs_meet_under_one_token(spark):
    held = {i: range(40 * (i % 2), 100 + i) for i in range(6)} | {6: range(9_000, 9_003)}
    tokens = spark.createDataFrame([(t, i) for i, own in held.items() for t in own], "token long, id long")
    each = ngramjoin.with_first(tokens)
    side = lambda s: each.select(F.col("token").alias(f"{s}_token"), F.col("id").alias(s), F.col("first").alias(f"{s}_first"))
    met = side("a").join(side("b"), F.expr("a_token = b_token AND a < b")).withColumn("token", F.col("a_token")).where(ngramjoin.meets_here())
    rows = [tuple(r) for r in met.select("a", "b").collect()]
    assert sorted(rows) == [(a, b) for a in range(6) for b in range(a + 1, 6)]


def test_heavy_tokens_are_counted_in_place():
    dice = np.random.default_rng(4)
    for n, least in ((0, 3), (2, 3), (5_000, 3), (5_000, 12)):
        tokens = dice.integers(0, 900, n).astype(np.uint64)
        token, count = np.unique(tokens, return_counts=True)
        found, times = ngramjoin.repeated(tokens.copy(), least)
        assert found.tolist() == token[count >= least].tolist()
        assert times.tolist() == count[count >= least].tolist()


def test_sketches_pass_linked_lines_and_stop_most_others(spark):
    dice = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: [dice.choice(words) for _ in range(n)]
    pairs = []
    for n in (1, 4, 5, 9, 20, 58, 120, 300):
        for _ in range(20):
            x = line(n)
            y = list(x)
            for _ in range(n // 5):
                i = dice.randrange(len(y))
                y[i : i + 1] = dice.choice(([dice.choice(words)], [], [y[i], dice.choice(words)]))
            pairs += [(" ".join(x), " ".join(y)), (" ".join(x), " ".join(line(n)))]
    frame = spark.createDataFrame([p for p in pairs if all(p)], "a string, b string")
    known = linededup.sketches(frame.select(F.col("a").alias("text")).union(frame.select("b")).distinct().select(F.xxhash64("text").alias("h"), "text"))
    odd = [f"odd{i}" for i in range(linededup.SKETCH)]
    side = lambda s: known.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in odd])
    each = frame.withColumns({f"{s}_id": F.xxhash64(s) for s in "ab"} | {f"{s}_n": F.size(F.split(s, " ")) for s in "ab"} | {f"{s}_x": linededup.spelled(F.split(s, " ")) for s in "ab"})
    told = each.join(side("a"), "a_id").join(side("b"), "b_id").select(linededup.similar(80, "a_x", "b_x").alias("linked"), linededup.alike(80).alias("alike"), "a_n")
    rows = told.collect()
    assert sum(r.linked for r in rows) >= 100 and all(r.alike for r in rows if r.linked)
    assert sum(r.alike for r in rows if not r.linked and 9 <= r.a_n <= 120) < 12


def test_line_dedup_common_pairs_bring_no_rows(spark):
    """Lines that have fewer than SHARED large blocks meet in none, and a line leaves its largest."""
    dice = random.Random(8)
    line = lambda i: " ".join([f"w{i}x{dice.randrange(1 << 30)}" for _ in range(8)] + ["common head and tail"] + [f"v{i}x{dice.randrange(1 << 30)}" for _ in range(8)])
    docs = spark.createDataFrame([(i, line(i)) for i in range(300)], "doc_id long, text string")
    once = docs.select(F.xxhash64("text").alias("h"), "text")
    again = spark.createDataFrame([], "h long, first struct<doc_id:long,line:int>")
    held = linededup.blocks(docs, again, 80)
    assert linededup.large(held, linededup.sketches(once), 80).count() == 0
    keys = linededup.keyed(spark.createDataFrame([(1, "a b a b a b a b a b")], "h long, text string"), 80).first()["keys"]
    assert len(keys) == len(set(keys)) == 8


def test_line_dedup_of_few_words_equals_all_pairs(spark):
    """Lines of few different words, so that all blocks are large and pairs of words repeat in a line."""
    dice = random.Random(9)
    words = ["lantern", "harbour", "meadow", "copper", "violet"]
    rows = []
    for _ in range(60):
        x = [dice.choice(words) for _ in range(dice.randrange(4, 24))]
        rows.append(x)
        for _ in range(2):
            y = list(x)
            for _ in range(dice.randrange(1, 2 + len(x) // 4)):
                i = dice.randrange(len(y))
                y[i : i + 1] = dice.choice(([dice.choice(words)], [], [y[i], dice.choice(words)]))
                y = y or [words[0]]
            rows.append(y)

    def edits(a: list, b: list) -> int:
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    root = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            if edits(a, rows[j]) <= 20 * max(len(a), len(rows[j])) // 100 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in linededup.repeats(docs).collect()} == {i for i, r in enumerate(root) if r != i}


def test_line_dedup_pairs_meet_under_one_block(spark):
    held = {i: range(i % 2, 30 + i) for i in range(6)} | {6: range(900, 903)}
    rows = spark.createDataFrame([(k, i) for i, own in held.items() for k in own], "key long, id long")
    each = linededup.with_first(rows)
    side = lambda s: each.select(F.col("key").alias(f"{s}_key"), F.col("id").alias(s), F.col("first").alias(f"{s}_first"))
    met = side("a").join(side("b"), F.expr("a_key = b_key AND a < b")).withColumn("key", F.col("a_key")).where(linededup.meets_here())
    assert sorted(tuple(r) for r in met.select("a", "b").collect()) == [(a, b) for a in range(6) for b in range(a + 1, 6)]
