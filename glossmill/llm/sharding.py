"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), so that equal texts lie together.  The driver never sees
rows: it sends candidate boundaries, every partition counts the exact bytes between them, and the
probes are refined inside the brackets that still hold a target, until every splitter meets the
tolerance.  Then the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, write_shared

_TOP = np.uint64(1 << 63)


def _rank(h: np.ndarray, d: np.ndarray, sh: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """How many of the splitters (sh, sd), which are sorted, are at most (h, d)."""
    lo, hi = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
    out = lo.copy()
    for a in np.unique(lo[hi > lo]):
        rows = np.flatnonzero((lo == a) & (hi > a))
        b = hi[rows[0]]
        out[rows] = a + np.searchsorted(sd[a:b], d[rows], "right")
    return out


def _unsigned(x) -> np.ndarray:
    """Signed 64-bit values as unsigned ones in the same order."""
    return np.asarray(x).astype(np.int64).view(np.uint64) ^ _TOP


def _histogram(keys: DataFrame, probes: list[tuple[int, int]]) -> dict[int, tuple[int, int, int, int]]:
    """bytes, rows, least and greatest hash of the rows in each interval between probes."""
    sh, sd = np.array([p[0] for p in probes], np.uint64), np.array([p[1] for p in probes], np.uint64)

    def count(batches):
        n = len(sh) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.zeros(n, np.uint64)
        for b in batches:
            h, d = _unsigned(b.column(0)), _unsigned(b.column(1))
            k = _rank(h, d, sh, sd)
            np.add.at(size, k, np.asarray(b.column(2)))
            rows += np.bincount(k, minlength=n)
            np.minimum.at(least, k, h)
            np.maximum.at(most, k, h)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(size[some]), pa.array(rows[some]), pa.array((least[some] ^ _TOP).view(np.int64)), pa.array((most[some] ^ _TOP).view(np.int64))],
            ["k", "size", "n", "least", "most"],
        )

    got = keys.mapInArrow(count, "k long, size long, n long, least long, most long").groupBy("k").agg(F.sum("size"), F.sum("n"), F.min("least"), F.max("most")).collect()
    return {r[0]: (r[1], r[2], r[3] + (1 << 63), r[4] + (1 << 63)) for r in got}


@dataclass
class _Bracket:
    target: float
    lo: tuple[int, int]
    hi: tuple[int, int]
    below: int
    upto: int
    done: tuple[int, int] | None = None


def splitters(keys: DataFrame, parts: int, slack: float, total: int, whole: float, probes: int = 24) -> list[tuple[int, int]]:
    """parts - 1 boundaries (hash, id) at which the bytes before come within ``slack`` of the wished ones.

    A group of equal hashes of at most ``whole`` bytes isn't divided.  keys: h, d, size.  Within a
    group, rows of one id are never divided.
    """
    top, full = (1 << 64, 0), 1 << 64
    if not total:
        return []
    want = [_Bracket(total * k / parts, (0, 0), top, 0, total) for k in range(1, parts)]
    for _ in range(200):
        todo = [b for b in want if b.done is None]
        if not todo:
            break
        marks: set[tuple[int, int]] = set()
        for b in todo:
            marks |= {b.lo, b.hi}
            if b.lo[0] == b.hi[0] or (b.lo[0] + 1 == b.hi[0] and b.hi[1] == 0):  # inside one group: by id
                end = b.hi[1] if b.hi[0] == b.lo[0] else full
                step = max(1, (end - b.lo[1]) // probes)
                marks |= {(b.lo[0], x) for x in range(b.lo[1] + step, end, step)}
            else:
                step = max(1, (b.hi[0] - b.lo[0]) // probes)
                marks |= {(x, 0) for x in range(b.lo[0] + step, b.hi[0], step)}
        at = sorted(m for m in marks if (0, 0) < m < top)
        found = _histogram(keys, at)
        sums, n = [0], 0
        for k in range(len(at) + 1):
            n += found.get(k, (0,))[0]
            sums.append(n)  # sums[k + 1]: bytes below at[k]
        edges = [(0, 0), *at, top]
        for b in todo:
            k = min(bisect_right(sums, b.target) - 1, len(edges) - 2)
            b.lo, b.hi, b.below, b.upto = edges[k], edges[k + 1], sums[k], sums[k + 1]
            near = b.lo if b.target - b.below <= b.upto - b.target else b.hi
            if min(b.target - b.below, b.upto - b.target) <= slack:
                b.done = near
                continue
            _, _, least, most = found[k]
            if b.hi[1] == 0 and b.lo[1] == 0 and least == most:  # one group of equal texts
                b.lo, b.hi = (least, 0), (least + 1, 0)
                if b.upto - b.below <= whole:
                    b.done = b.lo if b.target - b.below <= b.upto - b.target else b.hi
            elif b.lo[0] == b.hi[0] and b.hi[1] - b.lo[1] <= 1 or (b.lo[0] + 1 == b.hi[0] and b.hi[1] == 0 and full - b.lo[1] <= 1):
                b.done = near
    return [b.done or b.lo for b in want]


_FULL = (1 << 64) - 1


def _mixed(d: np.ndarray) -> np.ndarray:
    x = (d ^ (d >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)


class _Places:
    """Shard and range of a row: ranges cut a shard's span of hashes evenly; those of a hot text are cut again by id."""

    def __init__(self, cuts: list[tuple[int, int]], shards: int, fine: int):
        self.sh = np.array([min(x[0], _FULL) for x in cuts], np.uint64)
        self.sd = np.array([x[1] if x[0] <= _FULL else _FULL for x in cuts], np.uint64)
        self.shards, self.fine = shards, fine
        low = [0, *self.sh.tolist()][:shards] + [0] * max(0, shards - 1 - len(cuts))
        high = [*self.sh.tolist(), _FULL][:shards] + [_FULL] * max(0, shards - 1 - len(cuts))
        self.low = np.array(low, np.uint64)
        self.step = np.array([min(_FULL, max(1, (b - a) // fine + 1)) for a, b in zip(low, high, strict=True)], np.uint64)
        self.split = np.ones(shards * fine, np.int64)

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.split) - self.split

    def of(self, a, b) -> np.ndarray:
        h, d = _unsigned(a), _unsigned(b)
        s = _rank(h, d, self.sh, self.sd)
        cell = np.minimum((h - self.low[s]) // self.step[s], np.uint64(self.fine - 1)).astype(np.int64) + s * self.fine
        more = self.split[cell]
        return self.first[cell] + np.where(more > 1, (_mixed(d) % more.astype(np.uint64)).astype(np.int64), 0)


def shard(df: DataFrame, shards: int, text: str = "text", key: str = "doc_id", size=None, tolerance: float = 0.001, group_slack: float = 0.01, task_bytes: int = 1 << 28) -> DataFrame:
    """Every row of df with ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in each shard).

    Law: near equal bytes.  A boundary lies within ``tolerance`` of a shard's mean size of where it
    should; a group of equal texts is divided only if it is larger than the largest row and than
    ``group_slack`` of the mean size, and then by id.  A task orders about ``task_bytes`` of a shard:
    slots follow the hash of the text, and in a larger group of equal texts a hash of the id.  Null
    texts are a group of size 8; a null id sorts first; ids that aren't whole numbers go by their hash;
    rows equal in text and id stay together; an empty table gives an empty result.  Other columns are
    kept; ``shard`` and ``slot`` get leading underscores if they are taken.
    """
    names = df.columns
    h, d, s = (fresh(names, x) for x in ("_h", "_d", "_size"))
    bucket, out_shard, slot = (fresh(names, x) for x in ("_bucket", "shard", "slot"))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8 if size is None else size
    number = F.col(key).cast("long") if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))
    df = df.withColumns({h: F.xxhash64(text), d: F.coalesce(number, F.lit(-(1 << 63)).cast("long")), s: size})
    keys = write_shared(df.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(s).alias("size")), "shard-keys")
    total, largest = keys.agg(F.sum("size"), F.max("size")).first()
    total, largest = total or 0, largest or 0
    mean = total / shards
    places = _Places(sorted(splitters(keys, shards, tolerance * mean, total, max(largest, group_slack * mean))), shards, max(1, -(-int(mean) // task_bytes)))

    def at(a, b):
        @F.pandas_udf("long")
        def place(a, b):
            import pandas as pd

            return pd.Series(places.of(a, b))

        return place(a, b)

    def count():
        # a row per range: as many as task_bytes are in all
        return {r[0]: (r[1], r[2]) for r in keys.groupBy(at("h", "d").alias("k")).agg(F.count(F.lit(1)), F.sum("size")).collect()} if total else {}

    counts = count()
    hot = {k: -(-v[1] // task_bytes) for k, v in counts.items() if v[1] > 4 * task_bytes}
    if hot:
        places.split[list(hot)] = list(hot.values())
        counts = count()
    own = np.repeat(np.arange(shards), places.split.reshape(shards, -1).sum(1))
    ranges, n = [], [0] * shards
    for k, who in enumerate(own.tolist()):
        ranges.append((k, who, n[who]))
        n[who] += counts.get(k, (0, 0))[0]
    w = Window.partitionBy(bucket).orderBy(h, d)
    within = fresh(names, "_within")
    return (
        df.withColumn(bucket, at(h, d))
        .withColumn(within, F.row_number().over(w).cast("long") - 1)
        .join(F.broadcast(df.sparkSession.createDataFrame(ranges, f"{bucket} long, {out_shard} int, {slot} long")), bucket)  # one row per range
        .withColumn(slot, F.col(slot) + F.col(within))
        .select(*names, out_shard, slot)
    )


def op10_histogram_sort(spark, sf_dir) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null)."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
