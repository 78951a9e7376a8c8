"""What the operators share: tables in the cluster's shared folder and views of Arrow text."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where it is unset a temporary folder serves, but only in a single-machine session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="glossmill-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and returns it as read again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/glossmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, whose freed memory goes back when a task ends: workers outlive tasks, and would hold it beside those of later stages."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def crc_of_id(key: str = "doc_id"):
    """crc32 of the id as decimal text."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def fresh(taken: list[str], wanted: str) -> str:
    """A column name that doesn't clash with those taken."""
    name = wanted
    while name.lower() in {x.lower() for x in taken}:
        name = "_" + name
    return name


def as_text(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of an Arrow string or binary array without copying the bytes.

    A null counts as an empty text.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr), np.int64), np.zeros(len(arr), np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = off[:-1], off[1:].copy()
    if arr.null_count:
        gone = np.asarray(arr.is_null())
        ends[gone] = starts[gone]
    return raw, starts, ends


def runs(starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most ``limit`` bytes together (a longer row is alone)."""
    n, i = len(starts), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        yield i, min(j, n)
        i = j


def windows(starts: np.ndarray, ends: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Like runs(), as (row, start, end) arrays; longer rows come in pieces that overlap by ``overlap`` bytes.

    Sums over n-grams of overlap + 1 bytes are exact over such pieces.
    """
    for i, j in runs(starts, ends, limit):
        if j - i == 1 and ends[i] - starts[i] > limit:
            at = int(starts[i])
            while at < ends[i]:
                to = min(at + limit, int(ends[i]))
                yield np.array([i]), np.array([at]), np.array([to])
                if to == ends[i]:
                    break
                at = to - overlap
        else:
            yield np.arange(i, j), starts[i:j], ends[i:j]
