"""Configurations, their subsets, and their differences."""

from __future__ import annotations

import os
import re
import warnings
from typing import Any

import yaml


def load_config(path: str) -> dict | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def save_config(config: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, sort_keys=False, allow_unicode=True)


def resolve(config: dict) -> dict:
    """Replaces ${a.b} and ${divide:a,b} (a / b, cut to an integer); ??? is an error when met."""

    def look(path: str) -> Any:
        at: Any = config
        for p in path.strip().split("."):
            at = at[p]
        return walk(at, path)

    def put(m: re.Match) -> Any:
        body = m.group(1)
        if body.startswith("divide:"):
            a, b = (look(x) if not re.fullmatch(r"[\d.]+", x.strip()) else float(x) for x in body[7:].split(","))
            return int(a / b)
        return look(body)

    def walk(v: Any, path: str = "") -> Any:
        if isinstance(v, dict):
            return {k: walk(x, f"{path}.{k}".strip(".")) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x, path) for x in v]
        if v == "???":
            raise ValueError(f"{path} must be given")
        if isinstance(v, str) and (m := re.fullmatch(r"\$\{([^}]*)\}", v)):
            return put(m)
        return re.sub(r"\$\{([^}]*)\}", lambda m: str(put(m)), v) if isinstance(v, str) else v

    return walk(config)


def dataset_part(config: dict) -> dict:
    """What decides about the untokenized corpus."""
    data, out = config["dataset"], {"type": config["dataset"].get("type", "oscar"), "seed": config["seed"]}
    wanted = {"oscar": ("language",), "plaintext": ("path",), "plaintext_dir": ("directory",), "concat": ("sources",), "multinomial": ("sources", "alpha", "total_samples")}
    out |= {k: data[k] for k in wanted.get(out["type"], ())}
    if out["type"] == "plaintext_dir":
        out["pattern"] = data.get("pattern", "*.txt")
    if out["type"] == "multinomial":
        out["dev_size"] = config["training"]["dev_size"]
    return out


DEFAULTS = {"inherit_additional_special_tokens": True, "character_coverage": 1.0, "use_seed_vocabulary": False, "seed_filter_single_chars": True, "seed_min_frequency": 1}


def tokenizer_part(config: dict) -> dict | None:
    """What decides about a specialised vocabulary; None if there is none."""
    v = config.get("vocabulary", {})
    if not v.get("enabled"):
        return None
    out = {"hf_model": config["hf_model"], "vocab_size": v["vocab_size"], "num_samples": v["num_samples"], **{k: v.get(k, d) for k, d in DEFAULTS.items()}, "seed": config["seed"]}
    return out | ({"dataset": v["dataset"]} if v.get("dataset") else {"train_dataset_cache": config["dataset"]["cache_dir"]})


def tokenized_part(config: dict) -> dict:
    out = {"max_length": config["training"]["max_length"], "dev_size": config["training"]["dev_size"], "dataset": dataset_part(config)}
    tok = tokenizer_part(config)
    return out | ({"tokenizer": tok} if tok else {})


def diff(cached: dict, current: dict, path: str = "") -> list[str]:
    """Differences, sorted by key; lists are compared whole."""
    out = []
    for k in sorted({*cached, *current}, key=str):
        at = f"{path}.{k}" if path else str(k)
        if k not in current:
            out.append(f"{at}: only in the stored configuration")
        elif k not in cached:
            out.append(f"{at}: only in the wished configuration")
        elif isinstance(cached[k], dict) and isinstance(current[k], dict):
            out += diff(cached[k], current[k], at)
        elif cached[k] != current[k]:
            out.append(f"{at}: {cached[k]} (stored) is now {current[k]}")
    return out


def matches(cached: dict | None, current: dict, name: str, warn: bool = True) -> bool:
    """Whether a stored artifact's configuration is the current one (a missing one counts as such)."""
    found = [] if cached is None else diff(cached, current)
    if found and warn:
        warnings.warn(f"{name} was made with another configuration and is used nevertheless:\n" + "\n".join(f"  - {x}" for x in found), stacklevel=2)
    return not found


def flatten(config: dict, path: str = "") -> list[tuple[str, str]]:
    out = []
    for k, v in config.items():
        at = f"{path}.{k}" if path else str(k)
        out += flatten(v, at) if isinstance(v, dict) and v else [(at, str(v))]
    return out
