"""Defined results of the corpus operators for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pytest

from tessella.llm import bpe, frames, htmltext, langid, linededup, mixing, ngramjoin, quality, secrets, unitdedup, vafile


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'h' AS host", "1 AS shard")


def extracted(frame):
    return sorted((r.page_id, r.text) for r in htmltext.extract(frame).collect())


def test_html_pages_without_marks_keep_what_their_host_does_not_share(spark):
    menu = "<div>Home News Sports Weather Contact About Imprint Archive</div>"
    unique = ["A quiet river runs past the old stone mill today", "Nobody expected that the second bridge would hold so long", "Third text about tables and mending them by hand at night"]
    rows = [(i, "http://plain.example/p", f"<html><body>{menu}<p>{u}</p></body></html>") for i, u in enumerate(unique)]
    assert extracted(pages(spark, *rows)) == list(enumerate(unique))
    assert extracted(pages(spark, rows[0])) == [(0, f"Home News Sports Weather Contact About Imprint Archive\n\n{unique[0]}")]


def test_html_shared_blocks_of_articles_go_only_when_hinted_or_common(spark):
    shared = "This notice stands on every page of the host and says nothing new"
    other = "Words that two pages of the host quote from one and the same source"
    body = lambda i: f"<article><p>{shared}</p><p>Own words number {i} of page {i}</p>" + (f"<p>{other}</p><p class='cookie-notice'>{other}</p>" if i < 2 else "") + "</article>"
    found = dict(extracted(pages(spark, *[(i, "http://h.example/", body(i)) for i in range(8)])))
    assert found[5] == "Own words number 5 of page 5" and found[0] == f"Own words number 0 of page 0\n\n{other}"
    copies = dict(extracted(pages(spark, *[(i, "http://c.example/", f"<article><p>{shared}</p><p>{other}</p></article>") for i in range(8)])))
    assert set(copies.values()) == {f"{shared}\n\n{other}"}


@pytest.mark.parametrize("n", [1, 4, 8, 80])
def test_html_near_copied_articles_keep_all_text(spark, n):
    parts = [f"Paragraph {p} of the story that every one of these pages tells word by word" for p in range(5)]
    body = lambda i: "<article>" + "".join(f"<p>{p}</p>" for p in parts) + f"<p>Line {i} stands here alone</p></article><footer>menu</footer>"
    found = dict(extracted(pages(spark, *[(i, "http://copies.example/", body(i)) for i in range(n)])))
    assert found == {i: "\n\n".join([*parts, f"Line {i} stands here alone"]) for i in range(n)}


def test_html_odd_markup_has_defined_texts(spark):
    rows = [
        (1, None, "<article>&<b>amp;</b> &lt;x&gt; &#65;</article>"), (2, "no host", "plain < 5 words & more"), (3, "http://a.example", "<article><p class='related-work'>kept</p><div class='search-algorithms'>kept too</div><div class='related-posts'>gone</div></article>"),
        (4, "http://b.example", "<article><p>one<p>two<table><tr><td>3<td>4</table><ul><li>a<li>b</ul><span hidden>x</span></article><div class='comments'>gone</div>"), (5, "http://e.example", "<!-- open"), (6, "http://f.example", "<p>unclosed 'quote <a href='x>text"),
        (7, "http://g.example", "<article>" + "<b><p>word " * 5000 + "</article>"),
    ]
    found = dict(extracted(pages(spark, *rows)))
    assert found[1] == "&amp; <x> A" and found[2] == "plain < 5 words & more" and found[3] == "kept\n\nkept too"
    assert found[4] == "one\n\ntwo\n\n3\n\n4\n\na\n\nb" and found[5] == "" and len(found[7].split("\n\n")) == 5000
    twice = pages(spark, rows[0], rows[0])
    assert extracted(twice) == [(1, "&amp; <x> A")] * 2 and htmltext.extract(twice.where("false")).count() == 0


def test_html_shared_runs_equal_all_substrings():
    dice = random.Random(5)
    streams = [[dice.choice("abc") for _ in range(dice.randrange(0, 60))] for _ in range(12)]
    for s, got in zip(streams, htmltext.shared_runs(streams), strict=True):
        wanted = [0] * len(s)
        for lo in range(len(s) - htmltext.WIDTH + 1):
            gram = s[lo : lo + htmltext.WIDTH]
            held = sum(any(t[i : i + htmltext.WIDTH] == gram for i in range(len(t))) for t in streams)
            for i in range(lo, lo + htmltext.WIDTH):
                wanted[i] = max(wanted[i], held if held > 1 else 0)
        if len(s) >= htmltext.WIDTH:
            assert got.tolist() == wanted


def test_mixing_meets_targets_and_keeps_clashing_columns(spark):
    dice = random.Random(2)
    rows = [(i, "word " * dice.randrange(5, 60), dice.choice(["en", "en", "de"]), dice.choice(["web"] * 8 + ["wiki", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "9 AS probability", "8 AS weight", "7 AS t", "6 AS mass", "5 AS topic", "true AS sampled")
    targets = {"source": {"web": 0.4, "wiki": 0.4, "(none)": 0.2}, "lang": {"en": 0.5, "de": 0.5}}
    mixed = mixing.mix(docs, targets, 0.2).collect()
    mass = {}
    for r in mixed:
        for key in (r["__source"], r["__lang"]):
            mass[key] = mass.get(key, 0) + r["__weight"] * r["__tokens"]
    total = sum(r["__tokens"] for r in mixed)
    assert all(mass[k] / total == pytest.approx(v, abs=0.01) for part in targets.values() for k, v in part.items())
    assert sum(r["__probability"] * r["__tokens"] for r in mixed) == pytest.approx(0.2 * total, rel=0.01)
    drawn = mixing.sample(docs.union(docs), targets, 0.2)
    assert drawn.columns == docs.columns and drawn.count() == 2 * mixing.sample(docs, targets, 0.2).count() > 0
    with pytest.warns(UserWarning, match="marginals"):
        mixing.rake(spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, t long"), {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}})


def test_quality_scores_do_not_depend_on_batches_and_split_labels(spark):
    dice = random.Random(3)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    texts = [" ".join(dice.choice(good if i % 2 else bad) for _ in range(70)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS good", "2 AS score", "'q' AS quality")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int")
    one = {r.doc_id: r for r in quality.apply(docs.repartition(7), labels).collect()}
    two = {r.doc_id: r for r in quality.apply(docs.coalesce(1), labels).collect()}
    assert all(one[i].score == two[i].score and one[i].kept == two[i].kept == bool(i % 2) for i in one)
    alone = quality.apply(docs, labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in alone)
    assert quality.best_threshold([(0.1, 0), (0.3, 0), (0.5, 1), (0.7, 1)]) == 0.4 and quality.best_threshold([(1.0, 1)]) == float("-inf")


def test_language_viterbi_equals_all_paths():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes = rng.integers(0, 6, size=3)
        first = np.concatenate(([0], np.cumsum(sizes)))
        scores = rng.integers(-3, 4, size=(first[-1], 3)).astype(float)
        path = langid.viterbi(scores, first, 1.5)
        value = lambda p, lo: sum(scores[lo + i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        for r, n in enumerate(sizes):
            if n:
                every = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
                assert value(path[first[r] : first[r + 1]], first[r]) == max(value(p, first[r]) for p in every)


def test_language_spans_ties_and_empty_tables(spark):
    words = {"en": ["the", "river", "thing"], "de": ["der", "fluß", "über"]}
    dice = random.Random(1)
    rows = [(i, " ".join(dice.choices(words[l], k=10)), l) for i in range(80) for l in [["en", "de"][i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'z' AS lang_pred", "0 AS bucket")
    model = langid.learn(docs)
    mixed = spark.createDataFrame([(1, "the river thing the river thing der fluß über der fluß über"), (2, None), (3, "5 !"), (4, "the " * 50_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.predict(mixed, model, spans=True).collect()}
    assert [(s.start, s.end, s.lang) for s in found[1].spans] == [(0, 6, "en"), (6, 12, "de")]
    assert (found[2].lang_pred, found[2].score, found[2].spans) == ("und", 0.0, []) and found[3].lang_pred == "und" and found[4].lang_pred == "en"
    assert langid.accept(docs, model).columns == docs.columns and langid.accept(docs.union(docs), model).count() == 160
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.predict(mixed, langid.learn(docs.where("false"))).collect()} == {"und"}


def test_unit_dedup_of_repeated_ids_nulls_and_empty_tables(spark):
    line = "a line of some twenty words that stands in several documents and so is removed from all of them but the first one"
    rows = [(1, line), (1, line), (2, f"own start\n{line}"), (None, line), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS start", "1 AS unit", "2L AS digest")
    found = unitdedup.removals(docs)
    assert [(r.doc_id, r.start, r.end, r.first_doc_id) for r in found.collect()] == [(2, 10, 10 + len(line), 1)]
    left = unitdedup.remove(docs, found)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, (r.text or "").strip()) for r in left.collect())[-1] == (4, "") and left.count() == 6
    assert unitdedup.removals(docs.where("false")).count() == 0


def test_secret_scan_of_null_paths_copies_and_rule_versions(spark):
    text = "token = 'abcdefghijkl'"
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (3, None), (3, None)], "doc_id long, text string").selectExpr("*", "'x' AS blob", "0 AS spans")
    findings, news = secrets.scan(docs)
    assert news.count() == 2 and sorted((r.doc_id or 0, len(r.spans)) for r in findings.collect()) == [(0, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    newer = tuple(secrets.Rule(r.kind, 2, r.pattern, 99, r.group, r.hints, r.fold) if r.kind == "assign" else r for r in secrets.RULES)
    again, more = secrets.scan(docs, news, newer)
    assert {r.rule_versions for r in more.collect()} == {"assign@2"} and all(r.spans == [] for r in again.where("doc_id = 3").collect())
    rows = lambda df: sorted((r.doc_id or 0, r.n_assign, r.spans) for r in secrets.digest(df).collect())
    assert rows(secrets.scan_increments(docs, 3)) == rows(findings)
    assert secrets.scan_increments(docs.where("false")).count() == 0


def test_topk_ties_repeats_and_other_lengths(spark):
    rows = [(i, [0.5, 0.25]) for i in range(0, 60)] + [(50, [0.1, 0.1]), (100, [1.0]), (101, [2.0]), (None, [0.5, 0.5]), (150, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS v", "3 AS cells")
    found = sorted(map(tuple, vafile.search(table).collect()))
    assert [r[2] for r in found if r[0] == 0] == [1, 2, 3, 4, 5] and [r for r in found if r[0] == 100] == [(100, 1, 101, 131072)]
    assert [r[3] for r in found if r[0] == 50] == [25 * 128 + 25 * 64] * 5


def test_topk_leaves_out_what_no_score_holds_and_meets_small_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=6).tolist() for _ in range(400)]
    vectors[7], vectors[8], vectors[50] = [1e30] * 6, [float(1 << 23)] + [0.0] * 5, vectors[49]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    kept = [None if i in (7, 8) else v for i, v in enumerate(vectors)]
    expected = vafile.brute(list(range(400)), kept)
    for block in (100, 1 << 25):
        assert sorted(map(tuple, vafile.search(table, block=block).collect())) == expected
    assert {r.vec_id for r in vafile.quantise(table, "vec_id", "embedding").collect()} == set(range(400)) - {7, 8}


def test_columns_of_any_name_pass_the_stages(spark):
    text = "the river runs past the old stone mill and the bridge over it"
    names = ["__id", "__gone", "id", "_id", "gone", "__lang", "__score", "lang_found", "score_found"]
    docs = spark.createDataFrame([(1, text, "en", *names), (2, f"{text}\nmore words follow here", "en", *names)], ["doc_id", "text", "lang", *names])
    left = linededup.remove(docs, linededup.repeats(docs))
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted([text, "more words follow here"])
    assert all(tuple(r)[3:] == tuple(names) for r in left.collect())
    known = langid.accept(docs, langid.learn(docs))
    assert known.columns == docs.columns


def test_join_of_near_copies_in_large_groups_and_of_repeated_ids(spark):
    dice = random.Random(9)
    base = [f"w{dice.randrange(900)}" for _ in range(60)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(dice.randrange(4)):
            own[dice.randrange(60)] = f"x{dice.randrange(10_000)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"y{dice.randrange(500)}" for _ in range(1400)) for _ in range(2)] + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 AS id", "1 AS token", "2 AS comp")
    w = [(t or "").split() for t in texts]
    sets = [{tuple(x[i : i + 4]) for i in range(len(x) - 3)} if len(x) > 3 else {tuple(x)} if x else set() for x in w]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.group(docs).collect()} == {i: (len(sets[i]), top(i)) for i in range(len(texts))}
    twice = ngramjoin.group(docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))).collect()
    assert len(twice) == 6
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    found = {r.id: r.component for r in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 150)} | {300: 300, 301: 300}
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_of_null_ids_and_odd_spaces(spark):
    rows = [(1, "Same   words\there"), (2, " same words here \n\n"), (None, "same words here"), (3, None), (2, " same words here \n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS line", "1 AS h", "2 AS key")
    gone = linededup.repeats(docs)
    assert {tuple(r) for r in gone.collect()} == {(2, 0)}
    left = linededup.remove(docs, gone)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.where("text IS NOT NULL").collect())[1] == (1, rows[0][1])


def test_bpe_of_repeated_rows_and_null_ids(spark):
    import public_tokenizers

    from tessella.llm.registry import VOCABULARY

    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string").selectExpr("*", "0 AS n_tokens", "'x' AS ids")
    found = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 1), (1, 1), (1, 1)]


def test_tokens_that_the_same_classes_hold_meet_once(spark):
    held = {1: [10, 20, 30], 2: [10, 20, 30], 3: [10, 20], 4: [10, 20, 30, 30], 5: [20, 10, 30], -6: [10, 20]}
    rows = spark.createDataFrame([(t, i) for t, ids in held.items() for i in ids], "token long, id long")
    kept = {}
    for r in ngramjoin.one_of_equals(rows).collect():
        kept.setdefault(r.token, []).append(r.id)
    assert {t: sorted(ids) for t, ids in kept.items()} == {1: [10, 20, 30], -6: [10, 20], 4: [10, 20, 30, 30]}
