"""Exact-count splits, samples and temperature mixtures, reproducible under any partitioning.

Order comes from md5 keys of (seed, purpose, source, row), never from where a row lies.  Positions in
that order are counted per key bucket, so that no task ranks a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_DIGITS = 3  # hexadecimal digits of the key: 4,096 buckets


def rank_key(seed: int, tag: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[p.cast("string") for p in parts]))


def draw_value(seed: int, tag: str, *parts: Column) -> Column:
    """60 pseudo-random bits."""
    return F.conv(F.substring(rank_key(seed, tag, *parts), 1, 15), 16, 10).cast("long")


def positions(df: DataFrame, by: Sequence[str], key: str, ties: Sequence[str], to: str = "rn") -> DataFrame:
    """Position from 1 in the order of (key, ties), within each value of ``by``.

    Equals row_number() over (partition by ``by`` order by key, ties); the windows are those of key
    buckets, and the buckets' offsets (4,096 a value) are joined.
    """
    by = list(by)
    df = df.withColumn("_bucket", F.conv(F.substring(key, 1, BUCKET_DIGITS), 16, 10).cast("int"))
    counts = df.groupBy(*by, "_bucket").count()
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy(*by, "_bucket").orderBy(key, *ties)
    ranked = df.withColumn("_in", F.row_number().over(within))
    return ranked.join(offsets, [*by, "_bucket"]).withColumn(to, (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in", "_bucket")


def dev_rows(n: int, dev_size: float) -> int:
    """At 1 and more a number of rows, below a share (rounded up)."""
    if dev_size <= 0:
        raise ValueError("dev_size must be positive")
    k = int(dev_size) if dev_size >= 1 else math.ceil(n * dev_size)
    if k <= 0 or k >= n:
        raise ValueError(f"dev_size {dev_size} leaves no row for one of the splits of {n} rows")
    return k


def split(df: DataFrame, dev_size: float, source: str = "source", row: str = "row_id", seed: int = 1) -> DataFrame:
    """df with ``split`` (dev or train) and ``pool_idx`` (from 0 within each source's train rows)."""
    sizes = {r[0]: r[1] for r in df.groupBy(source).count().collect()}
    spark = df.sparkSession
    plan = spark.createDataFrame([(s, n, dev_rows(n, dev_size)) for s, n in sizes.items()], f"{source} string, _n long, _dev long")
    ranked = positions(df.withColumn("_key", rank_key(seed, "split", F.col(source), F.col(row))), [source], "_key", [row])
    out = ranked.join(F.broadcast(plan), source)  # a row per source
    dev = F.col("rn") <= F.col("_dev")
    return out.withColumn("split", F.when(dev, "dev").otherwise("train")).withColumn("pool_idx", F.when(~dev, F.col("rn") - F.col("_dev") - 1)).drop("_key", "_n", "_dev", "rn")


def probabilities(sizes: Sequence[int], alpha: float) -> list[float]:
    """n_i ** alpha over their sum, added up from left to right."""
    powers = [float(n) ** alpha for n in sizes]
    total = 0.0
    for p in powers:
        total += p
    return [p / total for p in powers]


def allocate(sizes: Sequence[int], alpha: float, total: int) -> list[int]:
    """Rows for each source: floors of the shares, the remainder one each from the first source on."""
    if not any(sizes):
        raise ValueError("all sources are empty")
    counts = [int(p * total) for p in probabilities(sizes, alpha)]
    for i in range(total - sum(counts)):
        counts[i % len(counts)] += 1
    return counts


def draw(pool: DataFrame, plan: list[tuple[str, int, int]], source: str = "source", row: str = "row_id", seed: int = 1) -> DataFrame:
    """Rows of the pool (with pool_idx), for each (source, size, count) of the plan ``count`` of them.

    Without replacement where count <= size, else ``count`` independent draws.  Adds draw_idx.
    """
    spark = pool.sparkSession
    for name, n, k in plan:
        if k and not n:
            raise ValueError(f"source {name} is empty but {k} rows are to be drawn from it")
    schema = f"{source} string, _n long, _k long"
    small = spark.createDataFrame([p for p in plan if p[2] <= p[1]], schema)
    once = pool.join(F.broadcast(small), source).where(F.col("pool_idx") < F.col("_k")).withColumn("draw_idx", F.col("pool_idx")).drop("_n", "_k")
    large = [p for p in plan if p[2] > p[1]]
    if not large:
        return once
    at, spans = 0, []
    for name, n, k in large:
        spans.append((name, n, at, at + k))
        at += k
    of = spark.createDataFrame(spans, f"{source} string, _n long, _from long, _to long")
    j = spark.range(at).join(F.broadcast(of), (F.col("id") >= F.col("_from")) & (F.col("id") < F.col("_to")))  # a row per source
    draws = j.withColumn("draw_idx", F.col("id") - F.col("_from"))
    draws = draws.select(source, "draw_idx", F.pmod(draw_value(seed, "draw", F.col(source), F.col("draw_idx")), F.col("_n")).alias("pool_idx"))
    many = pool.join(draws, [source, "pool_idx"])
    return once.select(*pool.columns, "draw_idx").unionByName(many.select(*pool.columns, "draw_idx"))


def multinomial(df: DataFrame, alpha: float, total_samples: int, dev_size: float | None, source: str = "source", row: str = "row_id", seed: int = 1) -> tuple[DataFrame, DataFrame, list[tuple[str, int, int, int, float]]]:
    """(train, dev, report): a mixture of ``total_samples`` rows by sizes raised to ``alpha``.

    train has draw_idx and shuffle_key; dev keeps natural proportions; the report has for each source,
    in order of names, dev and train sizes, rows allocated and their percentage.
    """
    if total_samples <= 0:
        raise ValueError("total_samples must be positive")
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    if dev_size is None:
        raise ValueError("a multinomial mixture needs dev_size")
    if not 0 < dev_size < 1:
        raise ValueError("dev_size must be a fraction between 0 and 1")
    whole = split(df, dev_size, source, row, seed)
    sizes = {r[0]: (r[1], r[2]) for r in whole.groupBy(source).agg(F.count_if(F.col("split") == "dev"), F.count_if(F.col("split") == "train")).collect()}
    names = sorted(sizes)
    if not names:
        raise ValueError("the list of sources is empty")
    counts = allocate([sizes[s][1] for s in names], alpha, total_samples)
    pool = whole.where("split = 'train'")
    train = draw(pool, [(s, sizes[s][1], k) for s, k in zip(names, counts, strict=True)], source, row, seed)
    train = train.withColumn("shuffle_key", rank_key(seed, "shuffle", F.col(source), F.col(row), F.col("draw_idx")))
    dev = whole.where("split = 'dev'").drop("pool_idx")
    return train, dev, [(s, *sizes[s], k, 100 * k / total_samples) for s, k in zip(names, counts, strict=True)]


def shuffle(df: DataFrame, key: str = "shuffle_key", ties: Sequence[str] = ("source", "row_id", "draw_idx")) -> DataFrame:
    return df.orderBy(key, *ties)


def subset(df: DataFrame, k: int, row: str = "row_id", seed: int = 1) -> DataFrame:
    """k rows (all, if fewer) in a seeded choice; order them by ``row`` for the original order."""
    ranked = positions(df.withColumn("_key", rank_key(seed, "subset", F.col(row))).withColumn("_all", F.lit(0)), ["_all"], "_key", [row])
    return ranked.where(F.col("rn") <= k).drop("_key", "_all", "rn")


def allocation_table(spark: SparkSession, report: list[tuple[str, int, int, int, float]]) -> DataFrame:
    return spark.createDataFrame(report, "source string, dev_rows long, train_rows long, allocated long, percent double")
