"""Exact top-k inner products over a bit-sliced index.

Components are integers; a block of rows stores, for every component and every bit, a bitmap over its
rows.  A query's scores are the sum of shifted slices (a negative weight adds the complement), which a
tree of carry-save adders computes on whole bitmaps.  The best rows are then selected from the most
significant score slice downward; rows that tie at the boundary are resolved by their id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table, write_shared


def slices(x: np.ndarray, low: int, width: int) -> np.ndarray:
    """Bitmaps (component, bit, word) of x - low, one bit a row; the rows fill whole 64-bit words."""
    n, d = x.shape
    words = -(-n // 64)
    u = np.zeros((words * 64, d), np.uint32)
    u[:n] = x - low
    out = np.empty((d, width, words), np.uint64)
    for b in range(width):
        bits = ((u >> np.uint32(b)) & np.uint32(1)).astype(np.uint8).T
        out[:, b] = np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)
    return out


def digits(q: int) -> list[tuple[int, int]]:
    """Signed powers of two, no two adjacent, that add up to q, as (power, sign)."""
    out, p = [], 0
    while q:
        if q & 1:
            s = 2 - (q & 3)
            out.append((p, s))
            q -= s
        q >>= 1
        p += 1
    return out


def score_slices(index: np.ndarray, flipped: np.ndarray, query: np.ndarray, low: int) -> tuple[list[np.ndarray], int]:
    """Score slices from the least significant up, and what is to be added to the sum they hold."""
    width = index.shape[1]
    columns: dict[int, list[np.ndarray]] = {}
    shift = 0
    for d, q in enumerate(query.tolist()):
        shift += q * low
        for p, s in digits(q):
            rows = index[d] if s > 0 else flipped[d]
            for b in range(width):
                columns.setdefault(p + b, []).append(rows[b])
            if s < 0:
                shift -= ((1 << width) - 1) << p
    out, carry, p = [], None, 0
    while p <= max(columns, default=-1) or carry is not None:
        here = columns.get(p)
        m = np.array(here) if here else None
        if carry is not None:
            m = carry if m is None else np.concatenate([m, carry])
        kept = []
        while m is not None and len(m) > 1:
            k = len(m) // 3
            if k:
                a, b, c = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
                x = a ^ b
                kept.append((a & b) | (x & c))
                m = np.concatenate([x ^ c, m[3 * k :]])
            else:
                a, b = m[:1], m[1:2]
                kept.append(a & b)
                m = a ^ b
        out.append(m[0] if m is not None else np.zeros(index.shape[2], np.uint64))
        carry = np.concatenate(kept) if kept else None
        p += 1
    return out, shift


def select(score: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k greatest scores (all, if fewer); at the boundary the first rows."""
    sure, tied = np.zeros_like(valid), valid.copy()
    count = lambda x: int(np.bitwise_count(x).sum())
    have = 0
    for s in reversed(score):
        up = tied & s
        n = have + count(up)
        if n > k:
            tied = up
        else:
            sure, have = sure | up, n
            tied = tied & ~s
            if n == k:
                tied[:] = 0
                break
    rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(tied)[: k - have]])


NARROW = float(1 << 28)  # greater components don't enter the index
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "x", block: int = 16384, query_block: int = 2048) -> DataFrame:
    """query_id, rank, (key), score: each query's k rows of greatest integer inner product.

    vectors and queries have the key and an array of integers (of any numeric type); rows whose arrays
    are null or hold nulls take no part, nor does a query's own row (any with its id).  Of several
    queries with one id the one of least vector asks; rows that share an id all answer.  Ties go to the
    smaller id; with k or fewer other rows all are returned.  A shorter array counts as if zeros
    followed.  Every block of ``block`` rows meets every block of ``query_block`` queries; a block keeps k
    rows a query.  Rows with a component beyond NARROW stay out of the index: whatever meets them is
    computed in whole numbers of any size.  A score beyond 64 bits is returned as the nearest that fits;
    the order is that of the exact ones.
    """
    kind = vectors.schema[key].dataType.simpleString()
    out_schema = f"query_id {kind}, {key} {kind}, score long"
    def ok(df):
        return df.select(key, F.col(vector).cast("array<double>").alias(vector)).where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull()))

    vectors, queries = ok(vectors), ok(queries).groupBy(key).agg(F.min(vector).alias(vector))
    wide_if = F.exists(vector, lambda v: F.abs(v) > NARROW)
    narrow = F.filter(vector, lambda v: F.abs(v) <= NARROW)
    lows, highs = F.min(F.when(~wide_if, F.array_min(narrow))), F.max(F.when(~wide_if, F.array_max(narrow)))
    a = vectors.agg(F.max(F.size(vector)).alias("d"), lows.alias("low"), highs.alias("high"), F.count_if(wide_if).alias("wide"), F.count_if(~wide_if).alias("narrow")).first()
    b = queries.agg(F.max(F.size(vector)).alias("d"), F.count_if(wide_if).alias("wide"), F.count(F.lit(1)).alias("n")).first()
    spark = vectors.sparkSession
    if a["d"] is None or b["d"] is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score long")
    d = max(1, a["d"], b["d"])
    full = F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(d) - F.size(vector)))
    vectors, queries = vectors.withColumn(vector, full), queries.withColumn(vector, full)
    low, high = min(0, int(a["low"] or 0)), max(0, int(a["high"] or 0))
    width = max(1, (high - low).bit_length())
    exact = []
    if a["wide"]:
        exact.append(_exact(vectors.where(wide_if), queries, k, key, vector, kind))
    if b["wide"] and a["narrow"]:
        exact.append(_exact(vectors.where(~wide_if), queries.where(wide_if), k, key, vector, kind))
    if a["wide"] or b["wide"]:
        vectors, queries = vectors.where(~wide_if), queries.where(~wide_if)
    vectors, queries = (x.withColumn(vector, F.col(vector).cast("array<int>")) for x in (vectors, queries))

    def rows_of(batches, size):
        """Batches of at most ``size`` rows, as (ids, matrix)."""
        ids, xs, n = [], [], 0
        for b in batches:
            i = np.asarray(b.column(0))
            x = np.asarray(b.column(1).flatten()).reshape(len(i), d)
            while n + len(i) >= size:
                t = size - n
                ids.append(i[:t]), xs.append(x[:t])
                yield np.concatenate(ids), np.concatenate(xs)
                ids, xs, n, i, x = [], [], 0, i[t:], x[t:]
            if len(i):
                ids.append(i), xs.append(x)
                n += len(i)
        if n:
            yield np.concatenate(ids), np.concatenate(xs)

    def build(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for m, (i, x) in enumerate(rows_of(batches, block)):
            o = np.argsort(i, kind="stable")
            i, x = i[o], x[o]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + m]), pa.array([i.astype(np.int64).tobytes()]), pa.array([slices(x, low, width).tobytes()], pa.binary())], ["block", "ids", "bits"])

    def gather(batches):
        for i, x in rows_of(batches, query_block):
            yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int64).tobytes()]), pa.array([x.astype(np.int32).tobytes()])], ["query_ids", "queries"])

    index = write_shared(vectors.mapInArrow(build, "block long, ids binary, bits binary"), "bit-slices")
    asked = queries.mapInArrow(gather, "query_ids binary, queries binary")
    blocks = [r[0] for r in index.select("block").collect()]

    def search(table_: pa.Table) -> pa.Table:
        rows = table_.to_pylist()
        qid, vid, sc = [], [], []
        for r in rows:
            ids = np.frombuffer(r["ids"], np.int64)
            bits = np.frombuffer(r["bits"], np.uint64).reshape(d, width, -1)
            valid = np.packbits(np.arange(bits.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
            flipped = ~bits
            qs = np.frombuffer(r["queries"], np.int32).reshape(-1, d)
            for q, x in zip(np.frombuffer(r["query_ids"], np.int64).tolist(), qs, strict=True):
                got, shift = score_slices(bits, flipped, x, low)
                mine = valid
                a, b = np.searchsorted(ids, [q, q + 1])
                if b > a:
                    mine = valid.copy()
                    for t in range(a, b):
                        mine[t >> 6] &= ~(np.uint64(1) << np.uint64(t & 63))
                best = select(got, mine, k)
                w, s = best >> 6, (best & 63).astype(np.uint64)
                total = np.full(len(best), shift, np.int64)
                for p, sl in enumerate(got):
                    total += ((sl[w] >> s) & np.uint64(1)).astype(np.int64) << p
                qid.append(np.full(len(best), q)), vid.append(ids[best]), sc.append(total)
        cat = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))
        return pa.table({"query_id": cat(qid), key: cat(vid), "score": cat(sc)})

    numbers = F.array(*[F.lit(x) for x in blocks]) if len(blocks) < 500 else F.lit(blocks)
    pair = asked.withColumn("block", F.explode(numbers.cast("array<long>"))).join(index, "block")
    pair = pair.withColumn("_one", F.xxhash64("block", "query_ids"))
    parts = max(1, min(20_000, len(blocks) * math.ceil(max(1, b["n"]) / query_block)))
    best = pair.repartition(parts, "_one").groupBy("_one").applyInArrow(search, out_schema).withColumn("_big", F.lit(b""))
    for x in exact:
        best = best.unionByName(x)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_big").desc(), F.col(key))
    rank = fresh([key, "query_id", "score"], "rank")
    return best.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).select("query_id", rank, key, "score")


def _exact(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, kind: str, block: int = 1024) -> DataFrame:
    """Candidates of each query among ``vectors``, with the score as it is returned and, where that was cut, bytes that sort like the exact one."""

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, block):
                some = b.slice(at, block)
                x = np.asarray(some.column(1).flatten()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(some.column(0)).astype(np.int64).tobytes()]), pa.array([x.tobytes()])], ["ids", "xs"])

    def whole(xs: bytes, n: int) -> np.ndarray:
        return np.array([int(v) for v in np.frombuffer(xs, np.float64).tolist()], object).reshape(n, -1)

    def score(table_: pa.Table) -> pa.Table:
        out = []
        for r in table_.to_pylist():
            ids, qids = np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["query_ids"], np.int64).tolist()
            s = whole(r["query_xs"], len(qids)) @ whole(r["xs"], len(ids)).T
            for q, row in zip(qids, s.tolist(), strict=True):
                best = sorted((-v, i) for v, i in zip(row, ids, strict=True) if i != q)[:k]
                for v, i in best:
                    v = -v
                    cut = min(MOST, max(LEAST, v))
                    out.append((q, i, cut, b"" if cut == v else (v + (1 << 4400)).to_bytes(552, "big")))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), key: pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64()), "_big": pa.array(cols[3], pa.binary())})

    held = write_shared(vectors.select(key, vector).mapInArrow(pack, "ids binary, xs binary"), "wide-rows").withColumn("_at", F.monotonically_increasing_id())
    asked = queries.select(key, vector).mapInArrow(pack, "query_ids binary, query_xs binary")
    held = write_shared(held, "wide-blocks")
    numbers = [r[0] for r in held.select("_at").collect()]
    pair = asked.withColumn("_at", F.explode(F.array(*[F.lit(x) for x in numbers]).cast("array<long>") if len(numbers) < 500 else F.lit(numbers))).join(held, "_at")
    pair = pair.withColumn("_one", F.xxhash64("_at", "query_ids"))
    return pair.groupBy("_one").applyInArrow(score, f"query_id {kind}, {key} {kind}, score long, _big binary")


def quantise(df: DataFrame, vector: str, to: str, factor: int = 64) -> DataFrame:
    """floor(factor * x) of every component, as whole doubles; null where a component is null or not finite.

    factor: a power of two, so that the product is exact.  A double that leaves the finite range by it
    counts as not finite.
    """
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * factor) == float("inf")))
    floor = lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)
    return df.withColumn(to, F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda v: floor(v.cast("double") * factor))))


def op5_bit_sliced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 20 best rows of each row whose id is divisible by 20."""
    x = quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "x").select("vec_id", "x").where("x is not null")
    return top_k(x, x.where("vec_id % 20 = 0"), 20)
