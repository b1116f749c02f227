"""Scalar rules of selection, label encoding, schedules and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = 255
#: Raw label ids of the street-scene data set that count, in the order of their training ids.
STREET_IDS = (7, 8, 11, 12, 13, 17, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 31, 32, 33)
#: Fixed value: tokens of a run name that vary inside a family: ratio, seed, learning rate, commit hash.
VARYING = r"^(r\d+(\.\d+)?|s\d+|lr[\d.eE+-]+|[0-9a-f]{12})$"


def budget(ratio: float, n: int) -> int:
    """Rows to keep: half to even, as binary doubles round."""
    return round(ratio * n)


def tail_size(q: float, n: int) -> int:
    """Values in a tail of a share q, at least one."""
    if not 0.0 < q <= 1.0:
        raise ValueError(f"q={q} is no share above 0 and up to 1")
    return math.ceil(q * n)


def street_label(raw: Column) -> Column:
    """Raw ids that count to 0..18, all others to IGNORE."""
    table = F.create_map(*[x for i, r in enumerate(STREET_IDS) for x in (F.lit(r), F.lit(i))])
    return F.coalesce(table[raw], F.lit(IGNORE)).cast("int")


def scene_label(raw: Column) -> Column:
    """Ids from 1 shifted to 0; 0 is IGNORE."""
    return F.when(raw == 0, IGNORE).otherwise(raw - 1).cast("int")


def clamped_label(raw: Column, classes: int) -> Column:
    return F.when(raw >= classes, IGNORE).otherwise(raw).cast("int")


def family_of(name: Column) -> Column:
    """A run name without its varying tokens, or the name itself when nothing is left."""
    kept = F.array_join(F.filter(F.split(name, "_"), lambda t: ~t.rlike(VARYING)), "_")
    return F.coalesce(F.when(kept != "", kept), name)


def fit_tag(tag: Column, most: int = 64) -> Column:
    """Tags over the limit become their head and a short digest of the whole."""
    return F.when(F.length(tag) <= most, tag).otherwise(F.concat_ws("-", F.substring(tag, 1, most - 9), F.substring(F.sha1(tag), 1, 8)))


def is_close(a: Column, b: Column | float) -> Column:
    b = F.lit(b) if not isinstance(b, Column) else b
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def tile_origins(size: Column, crop: int, stride: int) -> Column:
    """Origins of sliding tiles along one side; the last tile ends flush."""
    last = F.greatest(F.lit(0), size - crop)
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def learning_rate(step: Column, base: float, total: int, warmup: int, kind: str = "poly", least: float = 0.0, ratio: float = 1e-6, power: float = 1.0) -> Column:
    """Rate at a 0-based step: linear warm-up, then poly, cosine or constant."""
    if kind not in ("poly", "cosine", "constant"):
        raise ValueError(f"unknown schedule {kind!r}")
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    shape = {"poly": F.pow(1.0 - done, F.lit(power)), "cosine": 0.5 * (1.0 + F.cos(math.pi * done))}.get(kind)
    after = F.lit(base) if shape is None else least + (base - least) * shape
    if warmup <= 0:
        return after
    return F.when(step < warmup, base * (ratio + (1.0 - ratio) * step / float(warmup))).otherwise(after)


def steps_of(epochs: int, rows: int, batch: int) -> int:
    """Optimizer steps; too few rows for one batch is an error."""
    steps = epochs * (rows // batch)
    if steps == 0:
        raise ValueError(f"{rows} rows make no full batch of {batch}")
    return steps


def draw_key(seed: int, key: Column) -> Column:
    """The order of a seeded draw without replacement: rows by this digest, then by key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
