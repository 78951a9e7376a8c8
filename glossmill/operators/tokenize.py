"""Encoding with public vocabularies, truncation, collation."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sampling

PIECE = 1 << 18
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


@lru_cache(4)
def load(path: str):
    """A function from texts to id lists, by the file's kind: .json (tokenizers) or .model (sentencepiece)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def vocabulary_of(path: str) -> list[tuple[str, int]]:
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return [(m.id_to_piece(i), i) for i in range(m.get_piece_size())]
    from tokenizers import Tokenizer

    return sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda x: x[1])


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of at most PIECE bytes together, or one longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    i = 0
    while i < len(texts):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield texts.slice(i, j - i)
        i = j


def give_back() -> None:
    """Returns freed memory to the system: a worker would hold it beside that of the next batch."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def encode(text: Column, path: str, most: int | None = None) -> Column:
    """The first ``most`` (all) ids of a text (null: null), in Arrow batches; the model is loaded once a worker.

    Lists of Python numbers take ten times the texts' memory and more, so that only PIECE bytes of texts
    are encoded at once, or one text.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(x: pa.Array) -> pa.Array:
        kind = pa.list_(pa.int32())
        out = [pa.array([], kind)]
        for part in pieces(x):
            texts = part.to_pylist()
            got = iter(load(path)([t for t in texts if t is not None]))
            out.append(pa.array([None if t is None else next(got)[:most] for t in texts], kind))
        whole = pa.concat_arrays(out)
        del out
        give_back()
        return whole

    return ids(text)


def id_counts(texts: DataFrame, path: str, size: int) -> DataFrame:
    """(id, freq) of the only column's texts, by a vocabulary of ``size`` ids; ids stay in the tasks, which send their counts."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in pieces(batch.column(0)):
                got = load(path)([t for t in part.to_pylist() if t is not None])
                total += np.bincount(np.fromiter(chain.from_iterable(got), np.int64), minlength=size)
            give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "freq"])

    return texts.mapInArrow(run, "id int, freq long").groupBy("id").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"))


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def mask(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(1))


def tokenize(df: DataFrame, path: str, max_length: int, dev_size: float | None = None, text: str = "text", row: str = "row_id", seed: int = 1) -> DataFrame:
    """input_ids and attention_mask instead of the text; split first where there is no ``split`` yet."""
    if "split" not in df.columns:
        if dev_size is None:
            raise ValueError("unsplit data need dev_size")
        named = df.withColumn("_s", F.lit("all"))
        df = sampling.split(named, dev_size, "_s", row, seed).drop("_s", "pool_idx").withColumn("split", F.when(F.col("split") == "dev", "test").otherwise("train"))
    out = df.withColumn("input_ids", encode(F.col(text), path, max_length)).drop(text)
    return out.withColumn("attention_mask", mask(F.col("input_ids")))


def collate(df: DataFrame, batch: str, pad_id: int, ids: str = "input_ids") -> DataFrame:
    """Pads to the longest of each batch; labels are the ids, -100 at padding."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    out = df.join(longest, batch)
    fill = F.col("_longest") - F.size(ids)
    return (
        out.withColumn("labels", F.concat(F.col(ids), F.array_repeat(F.lit(-100), fill)))
        .withColumn("attention_mask", F.concat(mask(F.col(ids)), F.array_repeat(F.lit(0), fill)))
        .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), fill)))
        .drop("_longest")
    )
