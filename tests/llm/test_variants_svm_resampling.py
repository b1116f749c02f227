"""Spelling variants, the quality classifier and importance resampling against plain Python on small, awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import naivesvm, resampling, variants

CLASH = "text string, doc_id long, n long, word string, id long, bucket int, gain long, weight double, score double, rank int, quality int, `__row` long, f string"


def frame(spark, rows):
    return spark.createDataFrame([(t, i, 1, "w", 2, 3, 4, 5.0, 6.0, 7, 8, 9, "x") for i, t in rows], CLASH)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- spelling variants ---


def brute_words(rows, slip, least_length, least_count):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows, slip, least_length, least_count, times):
    words, out = brute_words(rows, slip, least_length, least_count), {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= times * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    for w, found in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (*found, root)
    return out


def check_variants(spark, rows, slip=7, least_length=4, least_count=2, times=2):
    found = variants.group(frame(spark, rows), slip=slip, least_length=least_length, least_count=least_count, times=times).collect()
    expected = brute_variants(rows, slip, least_length, least_count, times)
    assert {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in found} == expected
    assert len(found) == len(expected)
    return expected


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(stems).capitalize() if rng.random() < 0.2 else rng.choice(stems[: 1 + rng.randint(0, 29)]) for _ in range(60))) for i in range(20)]
    rows += [(None, "aaaa aaab aaaaa AAAAA"), (3, None), (4, ""), (5, "😀aaaab😀 ÀÉÎÕ àéîõ ÀÉÎÕ 1aaaa2"), *rows[:3], (99, "abcd" * 300 + " " + "abcd" * 300 + " " + "abcd" * 299 + "abce " + "abcd" * 299 + "abce")]
    expected = check_variants(spark, rows)
    assert any(v[0] for v in expected.values()) and any(v[4] != v[0] for v in expected.values() if v[0])


def test_variants_with_repeated_letters_ties_and_chains(spark):
    # No slips: counts as written. "aaaa" and its kin share all deletion keys; rivals of equal count tie by code point.
    say = lambda w, n: " ".join([w] * n)
    words = {"aaaa": 40, "aaaaa": 8, "aaab": 2, "zaaab": 2, "baaa": 8, "oooot": 3, "oooor": 3, "ooooz": 3, "oooo": 20, "oooox": 40}
    rows = [(i, say(w, n)) for i, (w, n) in enumerate(words.items())]
    expected = check_variants(spark, rows, slip=1 << 40)
    assert expected["zaaab"][4] == "zaaab" or expected["zaaab"][0]
    assert expected["oooot"][0] == "oooox"


def test_variants_of_nothing(spark):
    assert variants.group(frame(spark, [])).collect() == []
    assert variants.group(frame(spark, [(1, None), (2, "short ones here 12345678")])).collect() == []


def test_deletion_keys_are_those_of_the_strings():
    words = ["abcdef", "abdef", "é", "aab", "x" * 300]
    index, key, pos, first = variants.deletion_keys(words)
    seen = {}
    for i, k, p in zip(index, key, pos, strict=True):
        s = words[i] if p < 0 else words[i][:p] + words[i][p + 1 :]
        assert seen.setdefault(s, k) == k
    assert len(set(seen.values())) == len(seen)
    assert [bool(f) for i, p, f in zip(index, pos, first, strict=True) if words[i] == "aab" and p >= 0] == [True, False, True]


# --- importance resampling ---


def brute_resample(rows, target, ngrams, buckets, least, percent, seed):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall(lower(text))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(at, features(text)[1]))
    for text in target:
        t.update(map(at, features(text)[1]))
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        n, found = features(text)
        weight = sum(gain[at(f)] for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, n])
    able = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("ngrams", [1, 3])
def test_resampling_equals_plain_python(spark, ngrams):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["Alpha", "beta,", "год", "naïve", "42", "x-y", "_"]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 30))) for i in range(60)] + [(None, say(30)), (61, None), (62, ""), (63, say(5000)), (64, "...")]
    rows += [rows[3], rows[3], (7, say(25))]
    target = [say(20), None, "", "alpha alpha zzz"]
    options = {"ngrams": ngrams, "buckets": 50, "least_words": 10, "percent": 35, "seed": 11}
    found = resampling.resample(frame(spark, rows), frame(spark, list(enumerate(target))), **options).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_resample(rows, target, *options.values())
    assert found[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_ranks_hold_over_partitions_and_draw_keeps_columns(spark):
    rows = [(i, "word " * (20 + i % 5)) for i in range(300)]
    docs = frame(spark, rows)
    one = {r.doc_id: r.rank for r in resampling.resample(docs.coalesce(1), docs).collect()}
    assert one == {r.doc_id: r.rank for r in resampling.resample(docs.repartition(9), docs).collect()}
    assert sorted(r for r in one.values() if r) == list(range(1, 31))
    drawn = resampling.draw(docs, docs)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {i for i, r in one.items() if r}


def test_resampling_of_empty_tables(spark):
    some, none = frame(spark, [(1, "a b c")]), frame(spark, [])
    assert resampling.resample(none, some).collect() == []
    assert resampling.resample(some, none, least_words=1, percent=100).collect()[0].rank == 1


# --- quality classifier ---


def test_indicators_equal_plain_python():
    texts = ["One two one", None, "", "AB!! AB!! x1", "ü ü ü", "ein Wort"]
    row, bucket = naivesvm.indicators(pa.array(texts))
    assert len(set(zip(row, bucket, strict=True))) == len(row) and list(row) == sorted(row)
    per = Counter(row)
    # Words, pairs, shapes, pairs of shapes with equality, triples of shapes: all distinct.
    assert per[0] == 3 + 2 + 2 + 2 + 1 and per[1] == per[2] == 0 and per[4] == 1 + 1 + 1 + 1 + 1
    again = naivesvm.indicators(pa.array([texts[3]]))[1]
    assert set(again) == {b for r, b in zip(row, bucket, strict=True) if r == 3}


def test_descent_reaches_the_optimum_of_the_dual():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    rows = [np.append(r, naivesvm.BUCKETS) for r in rows]
    values = [np.full(9, 1 / 3.0) for _ in rows]
    good = np.array([(r[:-1] < 20).sum() + rng.integers(0, 3) > 4 for r in rows])
    weight = naivesvm.descend(rows, values, good, 1.0)
    sign = np.where(good, 1.0, -1.0)
    used = np.append(np.arange(40), naivesvm.BUCKETS)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(used, r)] = 1 / 3.0
    value = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    assert not np.delete(weight, used).any()
    best = value(weight[used])
    w = np.zeros(41)
    for step in range(1, 3000):
        w -= (w - x.T @ (sign * (sign * (x @ w) < 1))) / step
    assert best <= value(w) * 1.01


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["the", "river", "runs", "to", "stone", "and", "table"]) for _ in range(n))
    rows = [(i, say(rng.randint(8, 60)) if i % 3 else " | ".join(say(1).upper() + "!!" for _ in range(rng.randint(5, 40)))) for i in range(600)]
    rows += [(601, None), (602, ""), (None, say(20)), (603, say(9000)), rows[4], rows[4]]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0, "x") for i in range(600)] + [(None, 1, 0, "x"), (1, None, 0, "x"), (2, 7, 0, "x"), (9999, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    docs = frame(spark, rows)
    found = naivesvm.apply(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held) > 0
    # Batches and partitions change nothing, nor do the held-out labels.
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = naivesvm.apply(docs.repartition(7), flipped).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_classifier_without_labels_or_rows(spark):
    docs, labels = frame(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in naivesvm.apply(docs, labels).collect()} == {(0.5, 0)}
    assert naivesvm.apply(docs, labels.where("false")).count() == 2
    assert naivesvm.apply(frame(spark, []), labels).count() == 0
