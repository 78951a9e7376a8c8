"""Evaluation metrics over predicted token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PADDING = -100


def argmax(values: Column) -> Column:
    """Position from 0 of the greatest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_rows(logits: Column) -> Column:
    return F.transform(logits, argmax)


def distinctness(df: DataFrame, pred: str = "pred", label: str | None = "label", by: Sequence[str] = ()) -> DataFrame:
    """distinct_1_batch, distinct_1_seq and num_eval_tokens, for all or for each group.

    The distinct predictions of a batch are counted once; a sequence without valid ones doesn't count
    toward the mean over sequences; 0 where nothing is valid.
    """
    kind = dict(df.dtypes)[pred]
    if kind.startswith("array<array"):
        raise ValueError("predictions are token ids, not logits: take argmax_rows first")
    zipped = df.select(*by, F.col(pred).alias("p"), *([F.col(label).alias("l")] if label else []))
    v = F.col("p") if not label else F.transform(F.filter(F.arrays_zip("p", "l"), lambda x: x["l"] != PADDING), lambda x: x["p"])
    seqs = zipped.select(*by, v.alias("v"))
    per = seqs.groupBy(*by).agg(
        F.coalesce(F.avg(F.size(F.array_distinct("v")) / F.nullif(F.size("v"), F.lit(0))), F.lit(0.0)).alias("distinct_1_seq"),
        F.coalesce(F.sum(F.size("v")), F.lit(0)).cast("long").alias("num_eval_tokens"),
    )
    kinds = seqs.select(*by, F.explode("v").alias("t")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_kinds"))
    out = per.join(kinds, list(by), "left") if by else per.crossJoin(kinds)  # one row each
    batch = F.coalesce(F.coalesce("_kinds", F.lit(0)) / F.nullif("num_eval_tokens", F.lit(0)), F.lit(0.0))
    return out.select(*by, batch.alias("distinct_1_batch"), "distinct_1_seq", "num_eval_tokens")
