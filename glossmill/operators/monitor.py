"""Rules over the progress of a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def divergence(log: DataFrame, loss: str = "loss", step: str = "step", by: str = "run") -> DataFrame:
    """First step of each run at which the loss is not above 0."""
    return log.where(F.col(loss) <= 0).groupBy(by).agg(F.min(step).alias("diverged_at"))


def check_divergence(log: DataFrame, **names) -> None:
    bad = divergence(log, **names).orderBy("diverged_at").first()
    if bad:
        raise RuntimeError(f"the loss of run {bad[0]} dropped to zero at step {bad[1]}: it diverges")


def threshold(ratio: float, max_steps: int) -> int:
    return int(ratio * max_steps)


def trainable(name: Column, frozen_prefix: str | None) -> Column:
    """False for parameters that start frozen."""
    return ~name.startswith(frozen_prefix) if frozen_prefix is not None else F.lit(True)


def unfreeze(log: DataFrame, ratio: float, max_steps: int, step: str = "step", by: str = "run") -> DataFrame:
    """First step at or after the given share of training, and its checkpoint's name."""
    first = log.where(F.col(step) >= threshold(ratio, max_steps)).groupBy(by).agg(F.min(step).alias("unfreeze_step"))
    return first.withColumn("checkpoint", F.concat(F.lit("checkpoint-"), F.col("unfreeze_step").cast("string"), F.lit("-before-unfreeze")))


def early_stop(log: DataFrame, patience: int, delay_ratio: float, max_steps: int, loss: str = "eval_loss", step: str = "step", by: str = "run") -> DataFrame:
    """Step at which each run stops: after ``patience`` evaluations in a row that don't improve on the best.

    Evaluations before the delay set the best, but don't count.
    """
    order = Window.partitionBy(by).orderBy(step)
    best = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.where(F.col(loss).isNotNull()).withColumn("_up", F.when(best.isNull() | (F.col(loss) < best), 1).otherwise(0))
    late = marked.where(F.col(step) >= threshold(delay_ratio, max_steps))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    late = late.withColumn("_island", F.sum("_up").over(upto))
    misses = F.sum(1 - F.col("_up")).over(Window.partitionBy(by, "_island").orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return late.withColumn("_misses", misses).where(F.col("_misses") >= patience).groupBy(by).agg(F.min(step).alias("stop_step"))


def due(step: Column, max_steps: int, parts: int) -> Column:
    """True every max_steps / parts (cut) steps."""
    return F.pmod(step, F.lit(max(1, int(max_steps / parts)))) == 0
