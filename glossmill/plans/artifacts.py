"""Names, memoisation and invalidation of stored artifacts."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .config import DEFAULTS, load_config, matches, save_config, tokenizer_part


def _number(n: int) -> str:
    return f"{n // 1_000_000}m" if n >= 1_000_000 else f"{n // 1000}k" if n >= 1000 else str(n)


def suffix(config: dict) -> str:
    v = DEFAULTS | config["vocabulary"]
    model = config["hf_model"].split("/")[-1].replace("-", "").replace(".", "").lower()
    out = f"{model}_v{_number(v['vocab_size'])}_s{_number(v['num_samples'])}"
    out += "" if v["inherit_additional_special_tokens"] else "_no-additional"
    if v["use_seed_vocabulary"]:
        out += "_seeded" + (f"-min{v['seed_min_frequency']}" if v["seed_min_frequency"] > 1 else "") + ("" if v["seed_filter_single_chars"] else "-chars")
    return out


def identity(config: dict) -> str:
    """Sixteen hexadecimal digits that tell configurations apart which share a suffix."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def tokenizer_path(config: dict) -> str | None:
    return f"tokenizers/{config['dataset'].get('language')}/{suffix(config)}" if tokenizer_part(config) else None


def tokenized_path(config: dict) -> str:
    return f"{config['dataset']['cache_dir']}/tokenized" + (f"_vocab_{suffix(config)}" if tokenizer_part(config) else "")


def output_path(config: dict) -> str:
    if config.get("model_name"):
        return f"{config['output_dir']}/{config['model_name']}"
    name = config["training"]["name"].replace("_", "-")
    base = f"{config['output_dir']}/{config['dataset'].get('language')}/" + (f"vocab_{suffix(config)}_" if tokenizer_part(config) else "") + name
    return f"{base}_{config['experiment_id']}" if config.get("experiment_id") else base


def stored(spark: SparkSession, path: str, config: dict, make: Callable[[], DataFrame], name: str = "artifact", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The DataFrame stored at path, made and written first where it isn't complete.

    Complete: written to the end and with a manifest.  A manifest of another configuration warns, and
    the stored data serve.
    """
    manifest = os.path.join(path, "manifest.yaml")
    if os.path.exists(os.path.join(path, "data", "_SUCCESS")) and os.path.exists(manifest):
        matches(load_config(manifest), config, name)
        return spark.read.parquet(os.path.join(path, "data"))
    make().write.mode("overwrite").partitionBy(*partition_by).parquet(os.path.join(path, "data"))
    save_config(config, manifest)
    return spark.read.parquet(os.path.join(path, "data"))


def stale(config: dict, fresh_dataset: bool = False, fresh_tokenizer: bool = False, fresh_model: bool = False) -> list[str]:
    """Paths that a wish for fresh artifacts invalidates: each kind and all that derive from it."""
    cache, tok, out = config["dataset"]["cache_dir"], tokenizer_path(config), output_path(config)
    own = (config.get("vocabulary", {}).get("dataset") or {}).get("cache_dir")
    if fresh_dataset:
        return [p for p in (cache, own, tok, out) if p]
    if fresh_tokenizer:
        return [p for p in (tok, tokenized_path(config), out, *([f"{own or cache}/vocab_{suffix(config)}"] if tok else [])) if p]
    return [out] if fresh_model else []


def clean(root: str, paths: list[str]) -> list[str]:
    """Removes the paths that exist inside root; a path outside is an error."""
    base, gone = os.path.realpath(root), []
    for p in paths:
        full = os.path.realpath(os.path.join(base, p))
        if full == base or os.path.commonpath([base, full]) != base:
            raise ValueError(f"{p} isn't inside {root}")
        if os.path.exists(full):
            shutil.rmtree(full)
            gone.append(p)
    return gone
