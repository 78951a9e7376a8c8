"""Best-fit packing with certified bounds.

Pieces are spread evenly over partitions.  Each partition packs by best fit in order of decreasing
length and certifies its number of sequences with dual-feasible-function bounds.  Partitions that
need more sequences than their bound put the pieces of their unfilled sequences together and pack
these again, until the bounds hold, nothing is won or one partition is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, fresh, lean, runs, table, write_shared
from .tokens import encoder

CAPACITY = 1024


def lower_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of count[x] pieces of each length x needs fewer bins.

    The greatest of: the volume; the dual feasible functions that round (k + 1) x down
    (k = 1 .. 60); those that, for each e up to half the capacity, raise lengths above capacity - e to
    the capacity and drop those below e.
    """
    x = np.arange(len(count))
    n = count.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 61):
        up = (k + 1) * x
        f = np.where(up % capacity == 0, x * k, (up // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((f * n).sum()) // (k * capacity)))
    total, bins = np.cumsum(n), np.cumsum(n * x)
    for e in range(1, capacity // 2 + 1):
        large = int(total[-1] - total[min(capacity - e, len(n) - 1)])
        middle = int(bins[min(capacity - e, len(n) - 1)] - bins[e - 1])
        best = max(best, large + -(-middle // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece under best fit decreasing; equal lengths in the given order."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]) if n else np.zeros(1, int)
    free: dict[int, list[np.ndarray]] = {}  # space left -> bins
    spaces: list[int] = []
    bins = 0

    def put(space: int, some: np.ndarray) -> None:
        if len(some):
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append(some)

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        size, items = int(ordered[a]), order[a:b]
        if size == 0:  # an empty piece fits anywhere
            where[items], offset[items] = 0, 0
            bins = max(bins, 1)
            continue
        at = 0
        while at < len(items):
            k = bisect_left(spaces, size)
            if k < len(spaces):
                space = spaces.pop(k)
                some = np.concatenate(free.pop(space))
            else:
                space = capacity
                some = np.arange(bins, bins + -(-(len(items) - at) // (capacity // size)))
                bins += len(some)
            each = space // size
            left = len(items) - at
            whole = min(len(some), left // each)
            take = items[at : at + whole * each]
            where[take] = np.repeat(some[:whole], each)
            offset[take] = capacity - space + np.tile(np.arange(each) * size, whole)
            at += len(take)
            put(space - each * size, some[:whole])
            if whole < len(some):
                rest = min(len(items) - at, each)
                take = items[at : at + rest]
                where[take] = some[whole]
                offset[take] = capacity - space + np.arange(rest) * size
                at += rest
                put(space - rest * size, some[whole : whole + 1])
                put(space, some[whole + 1 :])
    return where, offset


def _at(f, level: int):
    def g(table_: pa.Table) -> pa.Table:
        return f(table_, level)

    return g


def pieces(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The documents' token ids with ``end`` after each, cut where a document is longer than ``capacity``.

    All pieces but a document's first are full.  Columns: the key, piece, start, length, ids_crc32,
    salt (spreads pieces evenly) and, if asked for, ids.  A null text counts as empty.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long, salt long" + ", ids array<int>" * keep_ids

    def cut(batches):
        import zlib

        from pyspark import TaskContext

        code = encoder(tokenizer)
        context = TaskContext.get()
        salt = (context.partitionId() if context else 0) << 33
        for batch in batches:
            raw, lo, hi = as_text(batch.column(1))
            for i, j in runs(lo, hi, 1 << 20):
                ids, counts = code.encode(raw, lo[i:j], hi[i:j], end)
                ids = np.ascontiguousarray(ids, "<u4")
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = counts - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(salt + np.arange(len(doc)))]
                salt += len(doc)
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[at, len(ids)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, [key, "piece", "start", "length", "ids_crc32", "salt", "ids"][: len(cols)])

    return df.select(key, text).mapInArrow(lean(cut), schema)


def pack(items: DataFrame, capacity: int = CAPACITY, task_rows: int = 200_000, rounds: int = 6, join: int = 16) -> DataFrame:
    """items (with columns length and salt, as pieces() makes them) with sequence_id and offset.

    A task packs about ``task_rows`` pieces.  Partitions that miss their bound exchange the pieces of
    unfilled sequences, in groups of ``join`` partitions but of ``task_rows`` pieces at most, as long as
    that saves sequences.  The result holds every row once; a sequence's pieces lie without gaps from
    offset 0 and have at most ``capacity`` tokens together.  Longer pieces are an error.  Equal lengths
    go in the order of salt; repeated rows are pieces of their own.  Other columns stay; sequence_id and
    offset get leading underscores if they are taken.  Only counts of partitions reach the driver.  An
    empty table gives an empty result.
    """
    names = items.columns
    part, state, spare = (fresh(names, x) for x in ("_part", "_state", "_spare"))
    seq, off = fresh(names, "sequence_id"), fresh(names, "offset")
    n, longest = items.agg(F.count(F.lit(1)), F.max("length")).first()
    if longest is not None and longest > capacity:
        raise ValueError(f"a piece of {longest} tokens exceeds {capacity}")
    parts = max(1, -(-n // task_rows))
    out_names = [*names, part, seq, off, state, spare]
    added = [T.StructField(part, T.LongType()), T.StructField(seq, T.LongType()), T.StructField(off, T.LongType()), T.StructField(state, T.IntegerType()), T.StructField(spare, T.LongType())]
    ddl = T.StructType([*items.schema.fields, *added])

    def settle(table_: pa.Table, level: int) -> pa.Table:
        """Packs one partition; state 1: in a sequence that its partition would like to fill better; spare: such sequences, in the first row."""
        at = table_.schema.get_field_index("length")
        table_ = table_.sort_by([("length", "descending"), ("salt", "ascending")])
        length = np.asarray(table_.column(at)).astype(np.int64)
        where, offset = best_fit(length, capacity)
        bins = int(where.max()) + 1 if len(where) else 0
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        fill = np.bincount(where, weights=length, minlength=bins)
        open_ = (fill < capacity) & (bins > bound)
        me = int(table_.column(part)[0].as_py())
        if bins >= 1 << 24:
            raise ValueError("task_rows is too large")
        base = (level << 56) | (me << 24)
        count = np.zeros(len(where), np.int64)
        count[:1] = open_.sum() + (bins << 32)
        return table_.append_column(seq, pa.array(base + where)).append_column(off, pa.array(offset)).append_column(state, pa.array(open_[where].astype(np.int32))).append_column(spare, pa.array(count)).select(out_names)

    done: DataFrame | None = None
    todo = items.withColumn(part, F.pmod(F.xxhash64("salt"), F.lit(parts)))
    before, open_before = None, None
    for level in range(rounds + 1):
        packed = write_shared(todo.groupBy(part).applyInArrow(_at(settle, level), ddl), f"packed-{level}")
        loose, groups, spare_bins, bins = packed.agg(F.sum(state), F.countDistinct(F.when(F.col(state) == 1, F.col(part))), F.sum(F.col(spare) % (1 << 32)), F.sum(F.shiftright(spare, 32))).first()
        if before is not None and bins >= before:  # nothing was won: the sequences of the round before stay
            done = open_before if done is None else done.unionByName(open_before)
            break
        last = level == rounds or not loose or groups <= 1
        kept = packed if last else packed.where(F.col(state) == 0)
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        before, open_before = spare_bins, packed.where(F.col(state) == 1)
        fewer = max(1, groups // join, -(-loose // task_rows))
        todo = open_before.select(*names, F.pmod(F.xxhash64("salt", F.lit(level)), F.lit(fewer)).alias(part))
    return done.select(*names, seq, off)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = write_shared(pieces(docs, tokenizer_path()), "pieces")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
