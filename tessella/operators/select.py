"""Selection methods behind one registry: rows in, rows with `selected` out, deterministic given the seed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import draw_key
from tessella.operators import cluster, coverage, greedy, kcenter, prune, scoring, semdedup, zcore
from tessella.plans.lineage import ranked

VIEWS = ("cls", "pmean", "tail")


def within(name: str, value: float, low: float, high: float, open_low: bool = False) -> None:
    if not (low < value <= high if open_low else low <= value <= high):
        raise ValueError(f"{name} must be in {'(' if open_low else '['}{low:g}, {high:g}], got {value}")


def taken(cls, cfg: dict) -> dict:
    return {f.name: cfg[f.name] for f in fields(cls) if f.name in cfg}


@dataclass(frozen=True)
class Prototypicality:
    k: int = 20
    keep: str = "hard"
    balance: float = 0.5
    n_init: int = 10
    max_iter: int = 300
    score: str = "centroid"
    q: float = 0.05

    @classmethod
    def of(cls, cfg: dict) -> Prototypicality:
        out = cls(**taken(cls, cfg))
        prune.check(0, 0, out.keep, out.balance)
        if out.score not in ("centroid", "patch_tail"):
            raise ValueError(f"score must be centroid or patch_tail, got {out.score!r}")
        within("q", out.q, 0, 1, True)
        return out


@dataclass(frozen=True)
class Fused:
    k: int = 50
    k_cls: int = 20
    keep: str = "hard"
    balance: float = 0.5
    n_init: int = 10
    max_iter: int = 300
    q: float = 0.05
    fusion: str = "meanrank"
    views: tuple = VIEWS

    @classmethod
    def of(cls, cfg: dict) -> Fused:
        out = cls(**taken(cls, cfg) | ({"views": tuple(cfg["views"])} if "views" in cfg else {}))
        prune.check(0, 0, out.keep, out.balance)
        if out.fusion not in scoring.FUSIONS:
            raise ValueError(f"fusion must be one of {scoring.FUSIONS}, got {out.fusion!r}")
        if not out.views or len(set(out.views)) < len(out.views) or not set(out.views) <= set(VIEWS):
            raise ValueError(f"views must be distinct ones of {VIEWS}, got {list(out.views)}")
        within("q", out.q, 0, 1, True)
        return out


@dataclass(frozen=True)
class PatchBalance:
    alpha: float = 0.5
    gamma: float = 1.0

    @classmethod
    def of(cls, cfg: dict) -> PatchBalance:
        out = cls(**{k: float(v) for k, v in taken(cls, cfg).items()})
        within("alpha", out.alpha, 0, 1, True)
        if out.gamma < 0:
            raise ValueError(f"gamma must be >= 0, got {out.gamma}")
        return out


@dataclass(frozen=True)
class PatchCoverage:
    rarity: float = 1.0
    saturation: float | None = None
    eps: float | None = 0.1
    strength: float = 0.0

    @classmethod
    def of(cls, cfg: dict) -> PatchCoverage:
        out = cls(**{k: None if v is None else float(v) for k, v in taken(cls, cfg).items()})
        if out.rarity < 0 or out.strength < 0:
            raise ValueError(f"rarity and strength must be >= 0, got {out.rarity} and {out.strength}")
        if out.eps is not None:
            within("eps", out.eps, 0, 1, True)
        return out


@dataclass(frozen=True)
class KCenter:
    eps: float | None = None

    @classmethod
    def of(cls, cfg: dict) -> KCenter:
        out = cls(**taken(cls, cfg))
        if out.eps is not None and out.eps <= 0:
            raise ValueError(f"eps must be above 0, got {out.eps}")
        return out


@dataclass(frozen=True)
class SemDedup:
    k: int = 20
    tau: float = 0.95
    keep: str = "hard"
    n_init: int = 10
    max_iter: int = 300

    @classmethod
    def of(cls, cfg: dict) -> SemDedup:
        out = cls(**taken(cls, cfg))
        prune.check(0, 0, out.keep, 0.0)
        within("tau", out.tau, 0, 1, True)
        return out


@dataclass(frozen=True)
class ZCore:
    draws: int = zcore.DRAWS
    subspace: int = zcore.SUBSPACE
    neighbours: int = zcore.NEIGHBOURS
    fall: float = zcore.FALL

    @classmethod
    def of(cls, cfg: dict) -> ZCore:
        return cls(**taken(cls, cfg))


def random(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """A seeded draw without replacement; smaller budgets are subsets of larger ones."""
    rows = features["items"]
    n = rows.count()
    prune.check(n, budget, "hard", 0.0)
    key = draw_key(seed, F.col("image_id"))
    return ranked(rows.withColumn("__key", key), [F.asc("__key"), F.asc("image_id")], "keep_rank", n).withColumn("selected", F.col("keep_rank") <= budget).drop("__key")


def subsample(rows: DataFrame, most: int | None, seed: int = 0) -> DataFrame:
    """At most `most` rows by the seeded draw's order, all if it is None."""
    return rows if most is None else rows.orderBy(draw_key(seed, F.col("image_id")), "image_id").limit(most)


def full(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    return features["items"].withColumn("selected", F.lit(True))


def clustered(rows: DataFrame, k: int, seed: int, cfg: Prototypicality | Fused | SemDedup, given: DataFrame | None) -> DataFrame:
    """Rows (image_id, row_idx, v) with cluster and distance, by given prototypes or by fitted ones."""
    if given is not None:
        return cluster.assigned(rows, given)
    return cluster.scored(rows, k, seed, cfg.n_init, cfg.max_iter)[0]


def need(features: dict, *names: str) -> None:
    missing = [n for n in names if features.get(n) is None]
    if missing:
        raise TypeError(f"this selection needs the feature blocks {missing}")


def prototypicality(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """Cluster, score by distance to the prototype or by the patch tail, prune.

    features: embedding (image_id, row_idx, v); patch_scores (image_id, distances) for patch_tail; prototypes, if given.
    """
    c = Prototypicality.of(cfg)
    need(features, "embedding", *["patch_scores"] * (c.score == "patch_tail"))
    rows = clustered(features["embedding"], c.k, seed, c, features.get("prototypes"))
    if c.score == "patch_tail":
        tails = features["patch_scores"].select("image_id", scoring.tail_mean("distances", c.q).alias("__tail"))
        rows = rows.withColumnRenamed("distance", "centroid_distance").join(tails, "image_id").withColumnRenamed("__tail", "distance")
    return prune.select_by_score(rows, budget, c.keep, c.balance)


def proto_fused(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """Fuse the views' ranks; the base embedding's clusters balance."""
    c = Fused.of(cfg)
    need(features, "embedding", *["patch_scores"] * ("tail" in c.views), *["cls"] * ("cls" in c.views))
    rows = clustered(features["embedding"], c.k, seed, c, features.get("prototypes")).withColumnRenamed("distance", "pmean")
    if "tail" in c.views:
        rows = rows.join(features["patch_scores"].select("image_id", scoring.tail_mean("distances", c.q).alias("tail")), "image_id")
    if "cls" in c.views:
        own = clustered(features["cls"], c.k_cls, seed, c, features.get("cls_prototypes"))
        rows = rows.join(own.select("image_id", F.col("distance").alias("cls")), "image_id")
    return prune.select_by_score(scoring.fuse(rows, list(c.views), c.fusion).withColumnRenamed("fused", "distance"), budget, c.keep, c.balance)


def patch_balance(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """Greedy coverage of prototype masses; the seed is not used. features: items, patches (image_id, proto_id, distance)."""
    c = PatchBalance.of(cfg)
    need(features, "items", "patches")
    mass = greedy.prototype_mass(features["patches"], c.gamma)
    k = int(cfg.get("K") or (mass.agg(F.max("proto_id")).first()[0] or 0) + 1)
    items = features["items"].select("image_id", "row_idx")
    order = greedy.greedy(greedy.packed(mass, items), budget, c.alpha, k)
    picked = items.sparkSession.createDataFrame([(int(i), n + 1) for n, i in enumerate(order)], "row_idx long, keep_rank long")
    return items.join(picked, "row_idx", "left").withColumn("selected", F.col("keep_rank").isNotNull())


def picked(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with the keep_rank of found (row_idx, keep_rank, ...) and selected."""
    return items.join(found, "row_idx", "left").withColumn("selected", F.col("keep_rank").isNotNull())


def patch_coverage(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """Rarity-weighted coverage of patch concepts; the seed is not used. features: items, patches (image_id, proto_id), and scores (image_id, value) for the hybrid."""
    c = PatchCoverage.of(cfg)
    need(features, "items", "patches", *["scores"] * (c.strength > 0))
    items = features["items"].select("image_id", "row_idx")
    return picked(items, coverage.choose(features["patches"], items, budget, saturation=c.saturation, rarity=c.rarity, eps=c.eps, bonus=features.get("scores"), strength=c.strength))


def k_center(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """Farthest points of the embedding (image_id, row_idx, v), exact or, with eps, over composable centres."""
    need(features, "embedding")
    rows = features["embedding"].select("image_id", "row_idx", "v")
    return picked(rows.select("image_id", "row_idx"), kcenter.choose(rows, budget, seed, KCenter.of(cfg).eps))


def sem_dedup(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """Clusters without near copies of cosine tau or more, then a seeded draw. features: embedding, and prototypes if given."""
    c = SemDedup.of(cfg)
    need(features, "embedding")
    return semdedup.choose(clustered(features["embedding"], c.k, seed, c, features.get("prototypes")), budget, seed, c.tau, c.keep)


def z_core(features: dict, budget: int, seed: int, cfg: dict) -> DataFrame:
    """Coverage scores of random subspaces less redundancy. features: embedding."""
    c = ZCore.of(cfg)
    need(features, "embedding")
    return zcore.choose(features["embedding"], budget, seed, draws=c.draws, subspace=c.subspace, neighbours=c.neighbours, fall=c.fall)


METHODS: dict[str, Callable[[dict, int, int, dict], DataFrame]] = {
    "random": random, "full": full, "prototypicality": prototypicality, "proto_fused": proto_fused, "patch_balance": patch_balance,
    "patch_coverage": patch_coverage, "kcenter": k_center, "semdedup": sem_dedup, "zcore": z_core,
}


def selector(method: str) -> Callable[[dict, int, int, dict], DataFrame]:
    if method not in METHODS:
        raise ValueError(f"unknown selection method {method!r}; there are {sorted(METHODS)}")
    return METHODS[method]


def select(method: str, features: dict, budget: int, seed: int = 0, cfg: dict | None = None) -> DataFrame:
    """(image_id) of the selected rows, in order of their ids."""
    return selector(method)(features, budget, seed, cfg or {}).where("selected").select("image_id").orderBy("image_id")


