"""From a configuration to tokenized splits."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokenize
from ..sources import corpus
from .artifacts import stored, tokenized_path
from .config import dataset_part, tokenized_part


def prepare(spark: SparkSession, config: dict, tokenizer_file: str, root: str = ".") -> DataFrame:
    """Corpus, splits, and ids cut to max_length, each stored under the configured cache."""
    cache = os.path.join(root, config["dataset"]["cache_dir"])
    raw = stored(spark, f"{cache}/untokenized", dataset_part(config), lambda: corpus.load(spark, config["dataset"], config["training"].get("dev_size"), config["seed"]), "corpus", ("split",))

    def make() -> DataFrame:
        presplit = not raw.where(~F.col("split").isin("train")).isEmpty()
        rows = raw.withColumn("row_id", F.concat_ws(":", "source_idx", F.to_json(F.struct("row_idx"))))
        rows = rows if presplit else rows.drop("split")
        return tokenize.tokenize(rows, tokenizer_file, config["training"]["max_length"], config["training"].get("dev_size"), seed=config["seed"])

    return stored(spark, os.path.join(root, tokenized_path(config)), tokenized_part(config), make, "tokenized corpus", ("split",))


def eval_splits(tokenized: DataFrame) -> list[str]:
    """Dev splits by name; ``test`` where there is none."""
    names = sorted(r[0] for r in tokenized.select("split").distinct().collect())
    return [n for n in names if n not in ("train", "test")] or [n for n in names if n == "test"]
