"""Layered run configuration: presets, fragments and dotted overrides, merged on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from copy import deepcopy
from pathlib import Path

try:
    import yaml
except ModuleNotFoundError:
    yaml = None

GROUPS = ("dataset", "selection", "features")
EMBEDDING = {"backbone": "dinov2_vitb14", "method": "patch_mean"}
#: The settings of the known selections, which their subsets' names hold.
VOCABULARY = {"K": 256, "n_sample": 200, "seed": 0}
TAILS = {"backbone": "dinov2_vitb14", "method": "patch_dist", "params": VOCABULARY}
PRESETS: dict[str, dict] = {
    "random": {"method": "random"},
    "full": {"method": "full"},
    "prototypicality-hard": {"method": "prototypicality", "name": "auto", "embedding": {"backbone": "dinov2_vitb14", "method": "cls"}},
    "prototypicality-easy": {"method": "prototypicality", "name": "auto", "keep": "easy", "embedding": {"backbone": "dinov2_vitb14", "method": "cls"}},
    "prototypicality-hard-nobal": {"method": "prototypicality", "name": "auto", "balance": 0.0, "embedding": {"backbone": "dinov2_vitb14", "method": "cls"}},
    "prototypicality-easy-nobal": {"method": "prototypicality", "name": "auto", "keep": "easy", "balance": 0.0, "embedding": {"backbone": "dinov2_vitb14", "method": "cls"}},
    "prototypicality-hard-patchmean": {"method": "prototypicality", "name": "auto", "embedding": EMBEDDING},
    "prototypicality-hard-patchtail": {"method": "prototypicality", "name": "auto", "k": 50, "score": "patch_tail", "embedding": EMBEDDING, "patch_scores": TAILS},
    "prototypicality-hard-tailfeature": {"method": "prototypicality", "name": "auto", "k": 50, "score": "patch_tail", "embedding": {"backbone": "dinov2_vitb14", "method": "tail_feature", "params": VOCABULARY | {"tail_pct": 5}}, "patch_scores": TAILS},
    "prototypicality-hard-fused": {"method": "proto_fused", "name": "auto", "views": ["cls", "pmean", "tail"], "embedding": EMBEDDING, "patch_scores": TAILS, "extra_embeddings": {"cls": {"backbone": "dinov2_vitb14", "method": "cls"}}},
    "patch-balance": {"method": "patch_balance", "name": "auto", "embedding": {"backbone": "dinov2_vitb14", "method": "patch_label", "params": VOCABULARY}, "patch_scores": TAILS},
}


def merge(low: dict, high: dict) -> dict:
    out = deepcopy(low)
    for key, value in high.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def environment(value: object) -> object:
    """Fill ${oc.env:NAME,default} from the environment, in nested values."""
    if isinstance(value, dict):
        return {k: environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [environment(v) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{oc\.env:([A-Za-z0-9_]+)(?:,([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)
    return value


def scalar(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def dotted(overrides: Iterable[str]) -> dict:
    """a.b=1 as nested values; the value is read as JSON where it is."""
    out: dict = {}
    for entry in overrides:
        path, sign, text = entry.partition("=")
        if not sign:
            raise ValueError(f"expected key=value, got {entry!r}")
        for key in reversed(path.split(".")):
            text = {key: scalar(text) if isinstance(text, str) else text}
        out = merge(out, text)
    return out


def compose(experiment: dict | None = None, overrides: Iterable[str] = (), fragments: dict[str, dict[str, dict]] | None = None, **names: str | None) -> dict:
    """Experiment < named fragments < overrides. A group given by name in the experiment stands for its fragment."""
    known = merge({"selection": PRESETS}, fragments or {})

    def fragment(group: str, name: str) -> dict:
        if name not in known.get(group, {}):
            raise FileNotFoundError(f"no fragment {name!r} in group {group!r}")
        return known[group][name]

    cfg: dict = {}
    fields = dict(experiment or {})
    for group in GROUPS:
        if isinstance(fields.get(group), str):
            cfg = merge(cfg, {group: fragment(group, fields.pop(group))})
    cfg = merge(cfg, fields)
    for group, name in names.items():
        if name is not None:
            cfg = merge(cfg, {group: fragment(group, name)})
    return environment(merge(cfg, dotted(overrides)))


def is_yaml(path: str | Path) -> bool:
    """Whether a file is YAML by its name; that needs the yaml package."""
    if Path(path).suffix not in (".yaml", ".yml"):
        return False
    if yaml is None:
        raise RuntimeError(f"{path}: reading and writing YAML needs the yaml package; JSON does not")
    return True


def save(cfg: dict, path: str | Path) -> None:
    """A resolved configuration as YAML or JSON, by the file's name."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(cfg, sort_keys=False) if is_yaml(path) else json.dumps(cfg, indent=2, sort_keys=True))


def load(path: str | Path) -> dict:
    text = Path(path).read_text()
    return (yaml.safe_load(text) if is_yaml(path) else json.loads(text)) or {}


def fragments(folder: str | Path) -> dict[str, dict[str, dict]]:
    """Named fragments of a folder of groups: GROUP/NAME.yaml or .json, for compose()."""
    files = sorted(p for p in Path(folder).glob("*/*") if p.suffix in (".yaml", ".yml", ".json"))
    out: dict[str, dict[str, dict]] = {}
    for file in files:
        out.setdefault(file.parent.name, {})[file.stem] = load(file)
    return out
