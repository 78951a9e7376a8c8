"""Divergence over a stream of log rows (an extension: the batch rule is monitor.divergence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diverged(log: DataFrame, loss: str = "loss", step: str = "step", by: str = "run") -> DataFrame:
    """Running table of each run's first step with a loss not above 0; write it in update mode."""
    return log.where(F.col(loss) <= 0).groupBy(by).agg(F.min(step).alias("diverged_at"))
