"""Command line: derive embeddings, select a subset, inspect it, append the report.

    python -m tessella derive --raw RAW --derived TABLE --vocabularies FOLDER --dataset D --backbone B --method M [--params JSON] [--split S]
    python -m tessella select --derived TABLE --manifest INDEX --dataset D --preset P --ratio R [--seed N] [--set KEY=VALUE ...] --out FOLDER [--force]
    python -m tessella inspect ... as select, with --out a folder for scores and clusters as CSV
    python -m tessella rare --counts TABLE --dataset D --out FILE [--k N]
    python -m tessella diagnose --derived TABLE --manifest INDEX --preset P --ks K ... [--seeds S ...] [--restarts N] [--reference K --ratio R] --out FOLDER
    python -m tessella tails --derived TABLE --manifest INDEX --preset P --qs Q ... --ratios R ... [--against PARAMS ...] --out FOLDER
    python -m tessella coverage --derived TABLE --backbone B --params JSON --patches N --subsets FILE ... --out FOLDER
    python -m tessella report --runs EXPORT [--ledger CSV] --out FILE [--include RE] [--exclude RE] [--overview FILE [--dataset D] [--rare C ...]]
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import config, naming, scalars
from tessella.operators import derive, diagnostics, scoring, select
from tessella.plans.lineage import cut
from tessella.sources import documents, ledger, store


def selected(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, dict, int]:
    """The scored pool with `selected`, the selection's config, and the pool's size."""
    cfg = config.compose({}, [f"selection.{x}" for x in args.set], selection=args.preset)["selection"]
    pool = store.manifest(spark, args.manifest)
    n = pool.count()
    ids = pool.select("image_id", "row_idx")
    if cfg["method"] == "patch_balance":
        features = {"items": ids, "patches": store.labelled_patches(spark, args.derived, ids, cfg)}
    else:
        features = store.features(spark, args.derived, ids, cfg)
    return select.selector(cfg["method"])(features, scalars.budget(args.ratio, n), args.seed, cfg), cfg, n


def run_select(spark: SparkSession, args: argparse.Namespace) -> str:
    began = time.time()
    rows, cfg, n = selected(spark, args)
    ids = rows.where("selected").select("image_id")
    name = naming.selection_name(cfg)
    path = f"{args.out}/{naming.subset_name(name, args.dataset, args.ratio, args.seed)}"
    meta = {"dataset": args.dataset, "method": cfg["method"], "name": name, "ratio": args.ratio, "seed": args.seed, "n_images": scalars.budget(args.ratio, n), "n_total": n, "selection_cfg": cfg}
    ledger.save_subset(spark, path, ids, meta | {"selection_seconds": round(time.time() - began, 3)}, args.force)
    return path


def run_inspect(spark: SparkSession, args: argparse.Namespace) -> str:
    rows, cfg, _ = selected(spark, args)
    documents.save_csv(rows.drop("v"), f"{args.out}/scores")
    if "quota" in rows.columns:
        documents.save_csv(diagnostics.clusters_frame(rows, int(cfg.get("k", select.Prototypicality.k))), f"{args.out}/clusters")
    return args.out


def run_derive(spark: SparkSession, args: argparse.Namespace) -> str:
    derive.run(spark, args.raw, args.derived, args.vocabularies, dataset=args.dataset, split=args.split, backbone=args.backbone, method=args.method, params=json.loads(args.params), train_path=args.train_raw, manifest=args.manifest)
    return args.derived


def run_rare(spark: SparkSession, args: argparse.Namespace) -> str:
    """Pixel counts (class_id, n), as a Parquet table or one of labels (class_id) to be counted, to the rare-class file."""
    table = spark.read.parquet(args.counts)
    counts = table if "n" in table.columns else table.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    documents.save_rare_classes(args.out, args.dataset, counts.where(F.col("class_id") != scalars.IGNORE), args.k)
    return args.out


def vectors(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(image_id, row_idx, v) of the embedding that a preset names."""
    cfg = config.compose({}, [f"selection.{x}" for x in args.set], selection=args.preset)["selection"]
    return store.features(spark, args.derived, store.manifest(spark, args.manifest).select("image_id", "row_idx"), cfg)["embedding"]


def run_diagnose(spark: SparkSession, args: argparse.Namespace) -> str:
    rows = vectors(spark, args)
    documents.save_csv(diagnostics.diagnose(rows, args.ks, args.seeds, args.restarts), f"{args.out}/silhouette")
    if args.reference:
        n = rows.count()
        documents.save_csv(diagnostics.stability(rows, args.ks, args.seeds, scalars.budget(args.ratio, n), args.reference, args.restarts), f"{args.out}/stability")
    return args.out


def run_tails(spark: SparkSession, args: argparse.Namespace) -> str:
    """The tail score against the centroid distance over q and ratio; with --against, tails of other vocabularies against the preset's."""
    cfg = config.compose({}, [f"selection.{x}" for x in args.set], selection=args.preset)["selection"]
    ids = store.manifest(spark, args.manifest).select("image_id", "row_idx")
    blocks = store.features(spark, args.derived, ids, cfg)
    c = select.Prototypicality.of(cfg)
    scores = select.clustered(blocks["embedding"], c.k, args.seed, c, None).select("image_id", "row_idx", "cluster", "distance")
    documents.save_csv(diagnostics.tail_checks(cut(scores), cut(blocks["patch_scores"]), args.qs, args.ratios), f"{args.out}/tails")
    if args.against:
        tail = lambda block: store.features(spark, args.derived, ids, {"patch_scores": block})["patch_scores"].select("image_id", scoring.tail_mean("distances", c.q).alias("score"))
        block = cfg["patch_scores"]
        others = {json.dumps(p, sort_keys=True): tail(block | {"params": block["params"] | p}) for p in map(json.loads, args.against)}
        documents.save_csv(diagnostics.sensitivity(tail(block), others, [scalars.budget(r, ids.count()) for r in args.ratios]), f"{args.out}/vocabularies")
    return args.out


def run_coverage(spark: SparkSession, args: argparse.Namespace) -> str:
    """Rare concepts covered by subset files, by a histogram derivation of the derived table."""
    spec = naming.EmbeddingSpec(args.backbone, method="kmeans_hist", params=json.loads(args.params))
    held = store.matching(store.derived(spark, args.derived), spec).select("image_id", F.posexplode("embedding").alias("proto_id", "share"))
    counts = cut(diagnostics.counts_of(held, args.patches).where("n > 0"))
    rare = diagnostics.rarest(counts.groupBy("proto_id").agg(F.sum("n").alias("total")), "proto_id", "total", args.rare)
    names = ledger.subsets(spark, args.subsets).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "image_id")
    items = counts.select("image_id").distinct().count()
    documents.save_csv(diagnostics.coverage(names, counts, items, rare), f"{args.out}/coverage")
    return args.out


def run_report(spark: SparkSession, args: argparse.Namespace) -> str:
    runs = ledger.exported_runs(spark, args.runs).withColumn("family", scalars.family_of(F.col("name")))
    for column in ("n_images",):
        runs = runs if column in runs.columns else runs.withColumn(column, F.lit(None).cast("int"))
    book = ledger.read_csv(spark, args.ledger) if args.ledger else None
    if args.overview:
        documents.overview(args.overview, runs, book, args.dataset, tuple(args.rare))
    return ", ".join(documents.append_report(args.out, runs, book, args.include, args.exclude)) or "nothing new"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name, run in (("select", run_select), ("inspect", run_inspect)):
        p = commands.add_parser(name)
        for flag in ("--derived", "--manifest", "--dataset", "--preset", "--out"):
            p.add_argument(flag, required=True)
        p.add_argument("--ratio", type=float, required=True)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--set", nargs="*", default=[])
        p.add_argument("--force", action="store_true")
        p.set_defaults(run=run)
    p = commands.add_parser("derive")
    for flag in ("--raw", "--derived", "--vocabularies", "--dataset", "--backbone", "--method"):
        p.add_argument(flag, required=True)
    p.add_argument("--params", default="{}")
    p.add_argument("--split", default="train")
    p.add_argument("--train-raw")
    p.add_argument("--manifest")
    p.set_defaults(run=run_derive)
    p = commands.add_parser("rare")
    for flag in ("--counts", "--dataset", "--out"):
        p.add_argument(flag, required=True)
    p.add_argument("--k", type=int, default=5)
    p.set_defaults(run=run_rare)
    for name, run in (("diagnose", run_diagnose), ("tails", run_tails)):
        p = commands.add_parser(name)
        for flag in ("--derived", "--manifest", "--preset", "--out"):
            p.add_argument(flag, required=True)
        p.add_argument("--set", nargs="*", default=[])
        if name == "diagnose":
            p.add_argument("--ks", type=int, nargs="+", required=True)
            p.add_argument("--seeds", type=int, nargs="+", default=[0, 1, 2])
            p.add_argument("--restarts", type=int, default=10)
            p.add_argument("--reference", type=int)
            p.add_argument("--ratio", type=float, default=0.2)
        else:
            p.add_argument("--qs", type=float, nargs="+", required=True)
            p.add_argument("--ratios", type=float, nargs="+", required=True)
            p.add_argument("--seed", type=int, default=0)
            p.add_argument("--against", nargs="*", default=[])
        p.set_defaults(run=run)
    p = commands.add_parser("coverage")
    for flag in ("--derived", "--backbone", "--out"):
        p.add_argument(flag, required=True)
    p.add_argument("--params", required=True)
    p.add_argument("--patches", type=int, required=True)
    p.add_argument("--subsets", nargs="+", required=True)
    p.add_argument("--rare", type=float, default=0.25)
    p.set_defaults(run=run_coverage)
    p = commands.add_parser("report")
    p.add_argument("--runs", required=True)
    p.add_argument("--out", required=True)
    for flag in ("--ledger", "--include", "--exclude", "--overview", "--dataset"):
        p.add_argument(flag)
    p.add_argument("--rare", type=int, nargs="*", default=[])
    p.set_defaults(run=run_report)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    said = args.run(spark, args)
    print(said, file=sys.stderr)
    return said


if __name__ == "__main__":
    main()
