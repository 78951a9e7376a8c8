"""Token counts, seed vocabularies, and checks of vocabularies."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_lines
from . import tokenize

SPECIAL = ("<unk>", "<s>", "</s>", "<pad>", "<mask>")
MARK = "▁"


def whitespace_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each word, with the mark of a word's start before it."""
    return df.select(*[c for c in df.columns if c != text], F.explode(F.split(text, r"[ \n]+")).alias("_w")).where("_w <> ''").withColumn("token", F.concat(F.lit(MARK), "_w")).drop("_w")


def token_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("freq"))


def rejection(token: Column, freq: Column, min_frequency: int = 1, special: bool = True, single: bool = False, registered: tuple[str, ...] = ()) -> Column:
    """Why a token isn't kept (null: it is); the first reason that applies."""
    never = F.lit(False)
    reason = F.when(freq < min_frequency, "below_min_frequency")
    reason = reason.when(token.isin(*SPECIAL) if special else never, "special_token")
    reason = reason.when(token.startswith("<madeupword") if special else never, "madeupword_token")
    reason = reason.when(token.isin(*registered) if special and registered else never, "registered_special")
    return reason.when(F.length(F.replace(token, F.lit(MARK), F.lit(""))) == 1 if single else never, "single_char")


def seed_vocabulary(counts: DataFrame, **options) -> DataFrame:
    """Kept tokens; order by freq descending, then by token."""
    return counts.where(rejection(F.col("token"), F.col("freq"), **options).isNull())


def reasons(counts: DataFrame, **options) -> DataFrame:
    r = rejection(F.col("token"), F.col("freq"), **options)
    return counts.withColumn("reason", r).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("n_tokens"), F.coalesce(F.sum("freq"), F.lit(0)).alias("total_freq"))


def profile(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


def validate(vocabulary: DataFrame, size: int) -> None:
    """Ids must be 0 .. size-1, each once."""
    n, ids, low, high = profile(vocabulary).first()
    if n != size:
        raise ValueError(f"vocabulary size is {n}, expected {size}")
    if n and (low != 0 or high != size - 1):
        raise ValueError(f"ids range from {low} to {high}, expected a range of 0 to {size - 1}")
    if ids != size:
        raise ValueError(f"ids aren't contiguous: {ids} different ones, expected {size}")


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sizes of two vocabularies and of their intersection, and its share of the new one in percent."""
    both = old.select("token", F.lit(1).alias("o"), F.lit(0).alias("w")).union(new.select("token", F.lit(0), F.lit(1)))
    per = both.groupBy("token").agg(F.max("o").alias("o"), F.max("w").alias("w"))
    shared = F.sum(F.col("o") * F.col("w"))
    return per.agg(F.sum("o").alias("old_size"), F.sum("w").alias("new_size"), shared.alias("shared"), (100.0 * shared / F.nullif(F.sum("w"), F.lit(0))).alias("percent_of_new"))


def tokenizer_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(id, token, freq) of a public vocabulary's ids in the stripped texts; blank texts count for nothing."""
    known = tokenize.vocabulary_of(path)
    pieces = df.sparkSession.createDataFrame(known, "token string, id int")  # as many as the vocabulary has
    counts = tokenize.id_counts(clean_lines(df.select(F.col(text).alias("text"))), path, len(known))
    return counts.join(F.broadcast(pieces), "id").select("id", "token", "freq")


def extract_seed_vocabulary(df: DataFrame, path: str, output: str, text: str = "text", **options) -> bool:
    """Writes the kept tokens and counts of a public vocabulary; False, and nothing done, if the output exists."""
    from ..sources import files

    if os.path.exists(output):
        return False
    files.write_seed_vocabulary(seed_vocabulary(tokenizer_counts(df, path, text), **options).select("token", "freq"), output)
    return True


def special_tokens(config: dict | None = None, inherit: bool = True) -> dict[str, object]:
    """Names and ids of special tokens with their defaults; further ones as user_defined_symbols."""
    config = config or {}
    out: dict[str, object] = {}
    for name, token, number in (("unk", "<unk>", 0), ("bos", "<s>", 1), ("eos", "</s>", 2), ("pad", "<pad>", -1)):
        out[f"{name}_piece"] = config.get(f"{name}_token") or token
        given = config.get(f"{name}_token_id")
        out[f"{name}_id"] = number if given is None else given
    more = [t for t in config.get("additional_special_tokens", ()) if inherit]
    if more:
        out["user_defined_symbols"] = ",".join(more)
    return out


def algorithm(class_name: str) -> str:
    """bpe or unigram, from the name of a tokenizer's model class."""
    low = class_name.lower()
    for known in ("unigram", "bpe"):
        if known in low:
            return known
    raise ValueError(f"no known tokenizer algorithm: {class_name}")
