"""Stores, ledgers, derivations, fits and the command line against plain numpy and Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import __main__ as command
from tessella.functions import scalars
from tessella.functions.naming import EmbeddingSpec, VocabSpec
from tessella.operators import cluster, derive, greedy, metrics, prune, report, scoring, submodular
from tessella.plans.lineage import ranked, ranked_within
from tessella.sources import datasets, documents, ledger, store
from tessella.streaming import sinks

ONE = {"dataset": "street", "split": "train", "backbone": "b", "source": "derived"}


def vectors(spark, rows, **more):
    frame = spark.createDataFrame(rows, "image_id string, embedding array<float>")
    return store.derivation(frame, **(ONE | {"method": "cls"} | more))


def test_upsert_replaces_keys_and_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "derived")
    assert store.derived(spark, path).count() == 0
    store.upsert(spark, path, vectors(spark, [("a", [1.0]), ("b", [2.0])]))
    store.upsert(spark, path, vectors(spark, [("a", [7.0])], method="patch_mean"))
    store.upsert(spark, path, vectors(spark, [("b", [3.0]), ("c", [4.0])]))
    store.upsert(spark, path, vectors(spark, [("b", [9.0])], params={"K": 2}))
    held = {(r.image_id, r.method, r.params): r.embedding[0] for r in store.derived(spark, path).collect()}
    assert held == {("a", "cls", "{}"): 1.0, ("b", "cls", "{}"): 3.0, ("c", "cls", "{}"): 4.0, ("a", "patch_mean", "{}"): 7.0, ("b", "cls", '{"K": 2}'): 9.0}
    ids = spark.createDataFrame([("c", 0), ("a", 1)], "image_id string, row_idx long")
    loaded = store.load(spark, path, ids, EmbeddingSpec.of({"backbone": "b"})).orderBy("row_idx").collect()
    assert [r.embedding[0] for r in loaded] == [4.0, 1.0]
    with pytest.raises(ValueError, match="have no"):
        store.load(spark, path, ids.union(spark.createDataFrame([("z", 2)], ids.schema)), EmbeddingSpec.of({"backbone": "b"}))
    with pytest.raises(LookupError):
        store.load(spark, path, ids, EmbeddingSpec.of({"backbone": "b", "method": "none"}))


def test_aligned_refuses_repeats_and_values_that_are_no_numbers(spark):
    ids = spark.createDataFrame([("a", 0)], "image_id string, row_idx long")
    for rows in ([("a", [1.0]), ("a", [2.0])], [("a", [float("nan")])], [("a", [None])]):
        with pytest.raises(ValueError):
            store.aligned(ids, spark.createDataFrame(rows, "image_id string, embedding array<float>"))
    with pytest.raises(ValueError):
        store.matrix_dim(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "image_id string, embedding array<float>"))


def test_ledger_keeps_its_columns_and_the_last_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for miou in (0.1, 0.2):
        ledger.append(spark.createDataFrame([("w1", miou, {"1": 0.5}, "x")], "wandb_run_id string, miou double, per_class_iou_json map<string,double>, other string"), path)
    rows = spark.read.parquet(path)
    assert set(rows.columns) == {*ledger.LEDGER, "line"} and rows.where("timestamp IS NULL").count() == 0
    assert [(r.miou, json.loads(r.per_class_iou_json)) for r in report.latest_ledger(rows).collect()] == [(0.2, {"1": 0.5})]
    file = tmp_path / "runs.csv"
    head = list(ledger.LEDGER)
    lines = [dict(wandb_run_id="w1", miou="0.3", notes="old"), dict(wandb_run_id="", miou="0.9"), dict(wandb_run_id="w1", miou="0.4", notes='say "new"')]
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if '"' in v else v
    file.write_text("\n".join([",".join(head), *(",".join(quoted(x.get(c, "")) for c in head) for x in lines)]) + "\n")
    assert [(r.miou, r.notes) for r in report.latest_ledger(ledger.read_csv(spark, str(file))).collect()] == [(0.4, 'say "new"')]


def test_subset_files_are_kept_refused_or_forced(spark, tmp_path):
    path = str(tmp_path / "street_random_0.1_0.json")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id string")
    meta = {"dataset": "street", "method": "random", "ratio": 0.1, "seed": 0, "n_images": 2}
    assert ledger.save_subset(spark, path, ids("b", "a"), meta)
    assert not ledger.save_subset(spark, path, ids("a", "b"), meta)
    with pytest.raises(FileExistsError):
        ledger.save_subset(spark, path, ids("a", "c"), meta)
    assert ledger.save_subset(spark, path, ids("a", "c"), meta, force=True)
    assert sorted(r.image_id for r in ledger.subsets(spark, path).collect()) == ["a", "c"]


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(2)
    rows = [(f"i{n:02d}", rng.normal(size=6).tolist(), rng.normal(size=(2, 3, 6)).tolist()) for n in range(12)]
    return rows, spark.createDataFrame(rows, "image_id string, cls array<double>, patch array<array<array<double>>>").cache()


def test_derivations_equal_numpy(spark, raw, tmp_path):
    rows, frame = raw
    spec = VocabSpec("b", K=3, n_sample=4, seed=1)
    vocab = derive.vocabulary(spark, str(tmp_path), spec, frame)
    again = derive.vocabulary(spark, str(tmp_path), spec, frame.where("false"))
    assert vocab.orderBy("proto_id").collect() == again.orderBy("proto_id").collect() and vocab.agg(F.sum("size")).first()[0] == 12 * 4
    centroids = np.array([r.centroid for r in vocab.orderBy("proto_id").collect()])
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1)
    got = {m: {r.image_id: np.array(r.embedding) for r in derive.derive(frame, m, {"K": 3, "tail_pct": 50}, vocab).collect()} for m in derive.DERIVATIONS}
    for name, cls, patch in rows:
        p = np.array(patch).reshape(6, 6)
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        sim = p @ centroids.T
        label, distance = sim.argmax(axis=1), 1 - sim.max(axis=1)
        unit = lambda v: v / np.linalg.norm(v)
        assert np.allclose(got["cls"][name], cls) and np.allclose(got["patch_mean"][name], unit(p.mean(axis=0)))
        assert np.allclose(got["kmeans_hist"][name], np.bincount(label, minlength=3) / 6) and (got["patch_label"][name] == label).all()
        assert np.allclose(got["patch_dist"][name], distance, atol=1e-8)
        assert np.allclose(got["tail_feature"][name], unit(p[np.argsort(-distance, kind="stable")[:3]].mean(axis=0)))
    for method in ("none", "patch_dist"):
        with pytest.raises(ValueError):
            derive.derive(frame, method)


def test_kmeans_rests_where_numpy_does(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)) + np.repeat(np.eye(5)[:3] * 6, 30, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, v array<double>")
    c = x[:4].copy()
    before = None
    while True:
        label = (x @ c.T).argmax(axis=1)
        if before is not None and (label == before).all():
            break
        before = label
        c = np.stack([x[label == j].sum(axis=0) for j in range(4)])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    found = cluster.fit(rows, 4, init="first_k")
    assert found.converged and np.allclose(found.centroids, c) and found.objective == pytest.approx((1 - (x @ c.T).max(axis=1)).sum())
    best = cluster.fit(rows, 3, restarts=3)
    assert len(set((x @ best.centroids.T).argmax(axis=1).reshape(3, 30)[:, 0])) == 3
    scored, _ = cluster.scored(rows, 3, restarts=2)
    got = {r.row_idx: r.cluster for r in scored.collect()}
    label, d, s = np.array([got[i] for i in range(90)]), 1 - x @ x.T, []
    for i in range(90):
        own = [d[i, j] for j in range(90) if label[j] == label[i] and j != i]
        a, b = np.mean(own), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        s.append((b - a) / max(a, b))
    assert cluster.silhouette(scored.select("v", "cluster")) == pytest.approx(np.mean(s))


def test_greedy_coverage_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(submodular, "TOLD", 4)
    rng = np.random.default_rng(6)
    m = np.where(rng.random((40, 5)) < 0.5, rng.random((40, 5)).round(3), 0.0)
    rows = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for i, r in enumerate(m)], "row_idx long, protos array<int>, masses array<double>")
    cover, left, wanted = np.zeros(5), list(range(40)), []
    for _ in range(12):
        gains = [round(float((((cover + m[i]) ** 0.5) - cover**0.5).sum()), 9) for i in left]
        at = left[int(np.argmax(gains))]
        wanted.append(at)
        cover += m[at]
        left.remove(at)
    assert greedy.greedy(rows, 12, 0.5, 5) == wanted == greedy.greedy(rows, 12, 0.5, 5, top=3)


def test_ranks_and_sums_do_not_depend_on_blocks(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11, "hot" if i % 3 else "cold") for i in range(60)], "row_idx long, score int, cluster string")
    order = [F.desc("score"), F.asc("row_idx")]
    one, many = ranked(rows, order, "at"), ranked(rows, order, "at", one_task=7)
    assert sorted(one.collect()) == sorted(many.select(*one.columns).collect())
    a, b = ranked_within(one, "cluster", "at", "own", 60), ranked_within(one, "cluster", "at", "own", 60, 7)
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())
    sums = scoring.running_sum(rows, "score", "row_idx", "total", 7).orderBy("row_idx").collect()
    assert [r.total for r in sums] == np.cumsum([(i * 37) % 11 for i in range(60)]).tolist()
    picked = prune.select_by_score(rows.withColumn("distance", F.lit(1.0)), 10, balance=1.0).where("selected").collect()
    assert len(picked) == 10 and sorted(r.row_idx for r in picked if r.cluster == "cold") == [0, 3, 6, 9]


def test_boundary_score_of_an_image_without_a_class_is_null(spark):
    rows = [(1, y, x, 255, 0) for y in range(3) for x in range(3)] + [(2, y, x, int(x > 1), int(x > 1)) for y in range(4) for x in range(4)]
    found = metrics.boundary_f(spark.createDataFrame(rows, "image_id int, y int, x int, target int, pred int"))
    assert {r.image_id: r.boundary_f for r in found.collect()} == {1: None, 2: 1.0} and metrics.boundary_mean(found).first()[0] == 1.0


def test_streams_upsert_and_append(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "derived")
    for part in ([("a", [1.0])], [("a", [2.0]), ("b", [3.0])]):
        vectors(spark, part).coalesce(1).write.mode("append").parquet(source)
        sinks.upsert_stream(spark.readStream.schema(store.DERIVED).parquet(source), path, str(tmp_path / "point")).awaitTermination()
    assert {r.image_id: r.embedding[0] for r in store.derived(spark, path).collect()} == {"a": 2.0, "b": 3.0}
    runs = spark.createDataFrame([("w", 0.5)], "wandb_run_id string, miou double")
    runs.write.parquet(str(tmp_path / "runs"))
    sinks.ledger_stream(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs")), str(tmp_path / "book"), str(tmp_path / "point2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "book")).count() == 1


def exported(n, family, method, ratio, seed, miou, state="finished"):
    config = {"dataset": {"name": "street"}, "model": {"name": "b0"}, "selection_method": method, "ratio": ratio, "recipe": {"name": "proxy", "seed_train": seed, "lr": 1e-4, "epochs": 100}}
    return {"id": f"id{n}", "name": f"{family}_r{ratio}_s{seed}", "url": "", "created_at": f"2024-01-{n + 1:02d}", "state": state, "config": config, "summary": {"final/miou": miou, "_step": 10, "_runtime": 3600}}


def test_report_only_grows(spark, tmp_path):
    runs = [exported(0, "cs_random", "full", 1.0, 0, 0.8), exported(1, "cs_random", "random", 0.1, 0, 0.4), exported(2, "cs_random", "random", 0.1, 1, 0.6), exported(3, "cs_proto", "proto", 0.1, 0, 0.6), exported(4, "cs_proto", "proto", 0.1, 1, 0.5, "crashed")]
    export, out = tmp_path / "runs.json", tmp_path / "report.md"
    export.write_text(json.dumps(runs[:3]))
    assert command.main(["report", "--runs", str(export), "--out", str(out)], spark) == "cs_random"
    first = out.read_text()
    assert "## Experiment 1: cs_random" in first and "50.00 ± 14.14" in first and "| 62.5 |" in first and "/runs/id2)" in first
    export.write_text(json.dumps(runs))
    assert command.main(["report", "--runs", str(export), "--out", str(out)], spark) == "cs_proto"
    assert out.read_text().startswith(first.rstrip("\n")) and "## Experiment 2: cs_proto" in out.read_text() and "id4" not in out.read_text() and "| 75.0 |" in out.read_text()
    assert command.main(["report", "--runs", str(export), "--out", str(out)], spark) == "nothing new"
    with pytest.raises(ValueError):
        documents.append_report(out, ledger.exported_runs(spark, str(export)), protected=(out,))


def test_overview_compares_methods_and_classes(spark, tmp_path):
    runs = [exported(0, "cs_random", "full", 1.0, 0, 0.8), exported(1, "cs_random", "random", 0.1, 0, 0.4), exported(2, "cs_random", "random", 0.1, 1, 0.5), exported(3, "cs_proto", "proto", 0.1, 0, 0.6), exported(4, "cs_other", "other", 0.1, 0, 0.2), exported(5, "cs_proto", "proto", 0.1, 1, 0.9, "crashed")]
    (tmp_path / "runs.json").write_text(json.dumps(runs))
    head = list(ledger.LEDGER)
    iou = lambda a, b, c: '"' + json.dumps({"0": a, "1": b, "2": c}).replace('"', '""') + '"'
    lines = [{"wandb_run_id": f"id{n}", "selection_method": m, "per_class_iou_json": iou(*v)} for n, m, v in ((1, "random", (0.5, 0.5, 0.1)), (2, "random", (0.7, 0.5, 0.3)), (3, "proto", (0.605, 0.4, 0.21)))]
    (tmp_path / "book.csv").write_text("\n".join([",".join(head), *(",".join(x.get(c, "") for c in head) for x in lines)]) + "\n")
    page = tmp_path / "overview.md"
    command.main(["report", "--runs", str(tmp_path / "runs.json"), "--ledger", str(tmp_path / "book.csv"), "--out", str(tmp_path / "report.md"), "--overview", str(page), "--dataset", "cityscapes", "--rare", "2"], spark)
    text = page.read_text()
    assert "| street | b0 | proto | +15.00 + | 1 | 0 | +15.00 |" in text and "| street | b0 | other | -25.00 - | 0 | 1 | -25.00 |" in text and "random |" not in text.split("## Classes")[0].split("\n", 4)[-1].replace("against random", "")
    assert "| sidewalk |  | 40.00 (-10.00) | 50.00 |" in text and "| building | yes | 21.00 (+1.00) | 20.00 |" in text and "| road |" not in text


def test_dataset_listings_pair_images_with_labels(spark, tmp_path):
    made = {
        "cityscapes": (["leftImg8bit/train/b/b_1_leftImg8bit.png", "leftImg8bit/train/a/a_2_leftImg8bit.png", "leftImg8bit/train/a/notes.txt", "leftImg8bit/val/a/v_leftImg8bit.png"], [("a_2", "gtFine/train/a/a_2_gtFine_labelIds.png"), ("b_1", "gtFine/train/b/b_1_gtFine_labelIds.png")]),
        "ade20k": (["images/train/x2.jpg", "images/train/x1.jpg", "images/train/x1.png"], [("x1", "annotations/train/x1.png"), ("x2", "annotations/train/x2.png")]),
        "camvid": (["train/q.png", "trainannot/q.png", "val/r.png"], [("q", "trainannot/q.png")]),
    }
    for name, (files, wanted) in made.items():
        root = tmp_path / name
        for f in files:
            (root / f).parent.mkdir(parents=True, exist_ok=True)
            (root / f).write_bytes(b"x")
        rows = sorted(datasets.dataset(spark, name, str(root), "train").collect(), key=lambda r: r.row_idx)
        assert [(r.image_id, r.row_idx) for r in rows] == [(i, n) for n, (i, _) in enumerate(wanted)] and all(r.label_path.endswith(f"{name}/{path}") for r, (_, path) in zip(rows, wanted, strict=True))
    subset = spark.createDataFrame([("x2",)], "image_id string")
    assert [r.image_id for r in datasets.dataset(spark, "ade20k", str(tmp_path / "ade20k"), "train", subset).collect()] == ["x2"]
    with pytest.raises(ValueError, match="not in the pool"):
        datasets.dataset(spark, "ade20k", str(tmp_path / "ade20k"), "train", spark.createDataFrame([("nobody",)], "image_id string"))
    with pytest.raises(ValueError, match="unknown"):
        datasets.dataset(spark, "none", "", "train")
    table = tmp_path / "classes.tsv"
    table.write_text("Idx\tRatio\tName\n1\t0.1\twall, surface\n2\t0.2\tbuilding\n")
    assert datasets.class_names(spark, str(table)) == ["wall", "building"] and datasets.class_names(spark, str(tmp_path / "none.tsv"), 2) == ["class_0", "class_1"]
    assert len(documents.class_names("camvid")) == 11 and scalars.steps_of(3, 25, 8) == 9
    with pytest.raises(ValueError):
        scalars.steps_of(3, 7, 8)


def test_commands_of_rare_classes_diagnostics_tails_and_coverage(spark, raw, tmp_path):
    rows, frame = raw
    p = {n: str(tmp_path / n) for n in ("raw", "derived", "vocabularies", "index.json", "counts", "rare.json", "out", "subsets")}
    frame.write.parquet(p["raw"])
    (tmp_path / "index.json").write_text(store.manifest_text([(r[0], f"/x/{r[0]}.png") for r in rows], "street", "b", "train"))
    shared = ["--raw", p["raw"], "--derived", p["derived"], "--vocabularies", p["vocabularies"], "--dataset", "street", "--backbone", "dinov2_vitb14", "--manifest", p["index.json"]]
    small = {"K": 3, "n_sample": 4, "seed": 0}
    for method, params in (("patch_mean", {}), ("patch_dist", small), ("patch_dist", small | {"seed": 1}), ("kmeans_hist", small)):
        command.main(["derive", *shared, "--method", method, "--params", json.dumps(params)], spark)
    held = {(r.method, r.source, r.image_path) for r in store.derived(spark, p["derived"]).where("image_id = 'i03'").collect()}
    assert held == {(m, "patch", "/x/i03.png") for m in ("patch_mean", "patch_dist", "kmeans_hist")} and store.derived(spark, p["derived"]).where("length(config_hash) <> 12").count() == 0
    spark.createDataFrame([(i % 4 if i % 9 else 255,) for i in range(50)], "class_id int").write.parquet(p["counts"])
    command.main(["rare", "--counts", p["counts"], "--dataset", "street", "--out", p["rare.json"], "--k", "2"], spark)
    assert len(json.loads((tmp_path / "rare.json").read_text())["rare_class_ids"]) == 2
    pick = ["--derived", p["derived"], "--manifest", p["index.json"], "--preset", "prototypicality-hard-patchtail", "--out", p["out"], "--set", "k=2", "n_init=1", "patch_scores.params.K=3", "patch_scores.params.n_sample=4"]
    command.main(["diagnose", *pick, "--ks", "2", "3", "--seeds", "0", "1", "--restarts", "1", "--reference", "2"], spark)
    command.main(["tails", *pick, "--qs", "0.5", "--ratios", "0.25", "--against", '{"seed": 1}'], spark)
    command.main(["select", *pick[:4], "--dataset", "street", "--ratio", "0.5", "--preset", "random", "--out", p["subsets"]], spark)
    command.main(["coverage", "--derived", p["derived"], "--backbone", "dinov2_vitb14", "--out", p["out"], "--params", json.dumps(small), "--patches", "6", "--subsets", p["subsets"] + "/*"], spark)
    read = lambda name: spark.read.csv(f"{p['out']}/{name}", header=True).count()
    assert [read(n) for n in ("silhouette", "stability", "tails", "vocabularies", "coverage")] == [2, 2, 1, 1, 1]


def test_rare_class_files_read_back(spark, tmp_path):
    counts = spark.createDataFrame([(0, 50), (1, 5), (2, 5), (3, 40)], "class_id int, n long")
    made = documents.save_rare_classes(tmp_path / "rare.json", "cityscapes", counts, 2)
    assert made["rare_class_ids"] == [1, 2] and made["rare_class_names"] == ["sidewalk", "building"] and made["pixel_freq"][0] == 0.5
    assert [r.class_id for r in ledger.rare_ids(spark, str(tmp_path / "rare.json")).orderBy("rank").collect()] == [1, 2]
    assert documents.class_names("other") is None


def test_commands_derive_and_select(spark, raw, tmp_path):
    rows, frame = raw
    p = {n: str(tmp_path / n) for n in ("raw", "derived", "vocabularies", "index.json", "subsets", "debug")}
    frame.write.parquet(p["raw"])
    (tmp_path / "index.json").write_text(store.manifest_text([(r[0], f"/x/{r[0]}.png") for r in rows], "street", "b", "train"))
    shared = ["--raw", p["raw"], "--derived", p["derived"], "--vocabularies", p["vocabularies"], "--dataset", "street", "--backbone", "dinov2_vitb14"]
    for method, params in (("cls", {}), ("patch_mean", {}), ("patch_dist", {"K": 3, "n_sample": 4, "seed": 0}), ("patch_label", {"K": 3, "n_sample": 4, "seed": 0})):
        command.main(["derive", *shared, "--method", method, "--params", json.dumps(params)], spark)
    pick = ["--derived", p["derived"], "--manifest", p["index.json"], "--dataset", "street", "--ratio", "0.25"]
    small = ["k=2", "n_init=1", "patch_scores.params.K=3", "patch_scores.params.n_sample=4"]
    for preset, settings in (("random", []), ("prototypicality-hard", small[:2]), ("prototypicality-hard-patchtail", small), ("patch-balance", [*small[2:], "embedding.params.K=3", "embedding.params.n_sample=4", "K=3"])):
        path = command.main(["select", *pick, "--preset", preset, "--out", p["subsets"], "--set", *settings], spark)
        assert ledger.subsets(spark, path).count() == 3
    command.main(["inspect", *pick, "--preset", "prototypicality-hard", "--out", p["debug"], "--set", *small[:2]], spark)
    assert spark.read.csv(p["debug"] + "/scores", header=True).count() == 12 and spark.read.csv(p["debug"] + "/clusters", header=True).count() == 2
