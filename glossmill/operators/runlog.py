"""Series, listings and long forms of training logs."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("run", "step", "epoch")


def valid(df: DataFrame, column: str):
    """Neither null nor NaN."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) if dict(df.dtypes)[column] in ("float", "double") else c.isNotNull()


def union(runs: Sequence[DataFrame]) -> DataFrame:
    if not runs:
        raise ValueError("no run was loaded")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def metric_counts(df: DataFrame) -> DataFrame:
    """metric, n: columns that hold a value, but for the axes, with the number of their values."""
    metrics = [c for c in df.columns if c not in AXES]
    one = df.agg(*[F.count_if(valid(df, c)).alias(c) for c in metrics])
    return one.unpivot([], metrics, "metric", "n").where("n > 0")


def expand(patterns: Sequence[str], available: Sequence[str]) -> list[str]:
    """Names in the patterns' order, each once; a glob stands for its sorted matches."""
    out: list[str] = []
    for p in patterns:
        found = sorted(m for m in available if fnmatchcase(m, p)) if any(c in p for c in "*?[") else [p]
        out += [m for m in found if m not in out]
    return out


def axis(df: DataFrame, wanted: str = "step") -> str:
    if wanted in df.columns and df.where(valid(df, wanted)).limit(1).count():
        return wanted
    return "epoch" if "epoch" in df.columns else "step"


def series(df: DataFrame, metric: str, x: str = "step") -> DataFrame | None:
    """x, value and run of one metric; None where it has no value."""
    if metric not in df.columns:
        raise ValueError(f"no metric {metric}; there are {', '.join(sorted(c for c in df.columns if c not in AXES))}")
    some = df.where(valid(df, metric))
    if not some.limit(1).count():
        return None
    return some.select(axis(some, x), metric, "run")


def melt(df: DataFrame, metrics: Sequence[str], x: str = "step") -> DataFrame:
    """x, run, metric_name, metric_value for every value of the metrics."""
    missing = [m for m in metrics if m not in df.columns]
    if missing:
        raise ValueError(f"no metric {', '.join(missing)}")
    wide = df.select(x, "run", *[F.col(m).cast("double").alias(m) for m in metrics])
    out = wide.unpivot([x, "run"], list(metrics), "metric_name", "metric_value")
    return out.where(valid(out, "metric_value"))
