"""Models, thresholds and shared runs come from all rows, whatever their number."""

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import htmltext, quality


def test_threshold_takes_every_labelled_row(spark):
    rng = np.random.default_rng(5)
    for n, places in ((2_000, 4), (2_000, 1), (3, 2)):
        rows = [(float(np.round(g * 0.3 + x, places)), int(g)) for g, x in zip(rng.integers(0, 2, n), rng.normal(size=n), strict=True)]
        found = quality.split(spark.createDataFrame(rows, "score double, good int").repartition(5))
        assert found == quality.best_threshold(rows)
    assert quality.split(spark.createDataFrame([(0.5, 1)], "score double, good int")) == float("-inf")


def test_quality_learns_from_more_than_20000_labels(spark):
    n = 20_400
    words = lambda a: F.concat_ws(" ", *[F.concat(F.lit(f"{a}{i}x"), (F.col("id") % 5).cast("string")) for i in range(60)])
    last = spark.range(n).orderBy(F.xxhash64("id").desc()).limit(400).select("id", F.lit(True).alias("late"))
    docs = spark.range(n + 200).join(F.broadcast(last), "id", "left").select(F.col("id").alias("doc_id"), F.when(F.col("id") >= n, words("b")).when(F.col("late"), words("c")).otherwise(words("a")).alias("text"))
    labels = spark.range(n + 200).select(F.col("id").alias("doc_id"), (F.col("id") < n).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    # Words of the last good documents by hash stand in no other: without them as trusted text they would score as bad.
    kept = quality.apply(docs, labels).groupBy((F.col("doc_id") < n).alias("good"), "kept").count()
    assert {(r.good, r.kept): r["count"] for r in kept.collect()} == {(True, True): n, (False, False): 200}


def test_html_texts_do_not_depend_on_the_shards_of_a_host(spark, monkeypatch):
    dice = np.random.default_rng(7)
    own = lambda n: " ".join(f"w{x}" for x in dice.integers(0, 9_999, n))
    often, twice, short = own(12), [own(10) for _ in range(15)], "All rights reserved"
    rows = []
    for i in range(30):
        p, q = f"<p>{often}</p>" if i % 3 else "", f"<p class='cookie-notice'>{twice[i // 2]}</p>"
        rows.append((i, "http://big.example/", f"<article>{p}<p>{own(40)}</p>{q}</article>"))
        rows.append((100 + i, "http://big.example/", f"<div>{twice[i // 2]}</div><p>{own(30)}</p>" if i % 4 else f"<p>{short}</p>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    texts = [sorted(tuple(r) for r in htmltext.extract(frame, shard).collect()) for shard in (1 << 30, 1_500, 100)]
    monkeypatch.setattr(htmltext, "BROADCAST_ROWS", 0)
    texts.append(sorted(tuple(r) for r in htmltext.extract(frame, 1_500).collect()))
    assert texts[0] == texts[1] == texts[2] == texts[3]
    plain = htmltext.main_text([htmltext.blocks(h) for _, _, h in rows])
    assert [(i, t) for i, _, t, _ in texts[0]] == sorted(zip([r[0] for r in rows], plain, strict=True))
    assert {t for i, _, t, _ in texts[0] if i == 100} == {""} and all(w not in t for _, _, t, _ in texts[0] for w in twice)
