"""Text corpora: one row a text, with split, source_idx, source_name and row_idx.

row_idx gives the order within a source; (source_idx, row_idx) that of a union.  It is a number, or for
lines of documents (doc, pos): the document's id and the line's number.
"""

from __future__ import annotations

import fnmatch
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_lines, docs_to_lines
from ..operators import sampling

RESERVED = ("train", "test")


def _named(df: DataFrame, idx: int, name: str, split: str = "train") -> DataFrame:
    return df.select(F.lit(split).alias("split"), F.lit(idx).alias("source_idx"), F.lit(name).alias("source_name"), "row_idx", "text")


def read_documents(spark: SparkSession, path: str, language: str, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Lines of one language's documents, as they are: neither stripped nor filtered."""
    docs = spark.read.parquet(path).where(F.col(lang) == language).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    lines = docs_to_lines(docs)
    return _named(lines.select(F.struct("doc", "pos").alias("row_idx"), F.col("line").alias("text")), 0, language)


def read_plaintext(spark: SparkSession, path: str, strict: bool = True, name: str | None = None, idx: int = 0) -> DataFrame:
    """Stripped, non-empty lines of a UTF-8 file.

    strict: bytes that aren't UTF-8 are an error (else U+FFFD).  FileNotFoundError and ValueError as
    soon as the file is missing or holds no such line.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"plain text file not found: {path}")
    raw = spark.read.format("binaryFile").load(path).select("content")
    text = F.col("content").cast("string")
    text = F.validate_utf8(text) if strict else F.make_valid_utf8(text)
    lines = raw.select(F.posexplode(F.split(text, "\r\n|\r|\n")).alias("row_idx", "text"))
    out = clean_lines(lines.withColumn("row_idx", F.col("row_idx").cast("long")))
    if out.isEmpty():
        raise ValueError(f"no non-empty lines in {path}")
    return _named(out, idx, name or os.path.basename(path))


def read_plaintext_lines(spark: SparkSession, path: str, name: str | None = None, idx: int = 0) -> DataFrame:
    """Like read_plaintext for files larger than a task: split by the reader, lenient about bytes.

    Rows are numbered in file order; the numbers grow but have gaps.
    """
    lines = spark.read.text(path).withColumn("row_idx", F.monotonically_increasing_id()).withColumnRenamed("value", "text")
    return _named(clean_lines(lines), idx, name or os.path.basename(path))


def read_plaintext_dir(spark: SparkSession, directory: str, pattern: str = "*.txt", strict: bool = True) -> DataFrame:
    """The files of a directory that match, in order of their names, each as read_plaintext()."""
    if not os.path.exists(directory):
        raise FileNotFoundError(f"directory not found: {directory}")
    if not os.path.isdir(directory):
        raise ValueError(f"not a directory: {directory}")
    names = sorted(n for n in os.listdir(directory) if fnmatch.fnmatchcase(n, pattern) and os.path.isfile(os.path.join(directory, n)))
    if not names:
        raise ValueError(f"no file in {directory} matches {pattern}")
    return concat([read_plaintext(spark, os.path.join(directory, n), strict) for n in names])


def concat(sources: list[DataFrame]) -> DataFrame:
    """Ordered union of the sources' train rows.

    Where kinds of row_idx differ, all become (doc, pos), with numbers as docs; docs of several types
    become strings, whole numbers padded so that their order stays.
    """
    if not sources:
        raise ValueError("the list of sources is empty")
    parts = [s.where("split = 'train'").withColumn("source_idx", F.lit(i)) for i, s in enumerate(sources)]
    if len({dict(p.dtypes)["row_idx"] for p in parts}) > 1:
        parts = [p if dict(p.dtypes)["row_idx"].startswith("struct") else p.withColumn("row_idx", F.struct(F.col("row_idx").alias("doc"), F.lit(0).alias("pos"))) for p in parts]
        kinds = [p.select("row_idx.doc").dtypes[0][1] for p in parts]
        number = lambda k: k in ("tinyint", "smallint", "int", "bigint")
        for i, (p, k) in enumerate(zip(parts, kinds, strict=True)):
            doc = F.col("row_idx.doc")
            if all(map(number, kinds)):
                doc = doc.cast("long")
            elif number(k):
                doc = F.lpad(doc.cast("string"), 20, "0")
            parts[i] = p.withColumn("row_idx", F.struct(doc.cast("long" if all(map(number, kinds)) else "string").alias("doc"), F.col("row_idx.pos").cast("int").alias("pos")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def mixture(sources: list[DataFrame], names: list[str], alpha: float, total_samples: int, dev_size: float | None, seed: int = 1) -> DataFrame:
    """A multinomial mixture: train rows (with shuffle_key) and one dev split a source, named after it."""
    if not sources:
        raise ValueError("the list of sources is empty")
    if len(set(names)) < len(names):
        raise ValueError("two sources have one name")
    if bad := [n for n in names if n in RESERVED]:
        raise ValueError(f"{bad[0]} is a reserved name")
    all_ = concat(sources).withColumn("source", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("source_idx") + 1)).withColumn("row_id", F.to_json(F.struct("row_idx")))
    train, dev, _ = sampling.multinomial(all_, alpha, total_samples, dev_size, seed=seed)
    cols = ["source_idx", F.col("source").alias("source_name"), "row_idx", "text"]
    return train.select(F.lit("train").alias("split"), *cols, "shuffle_key").unionByName(dev.select(F.col("source").alias("split"), *cols, F.lit(None).cast("string").alias("shuffle_key")))


def load(spark: SparkSession, config: dict, dev_size: float | None = None, seed: int = 1) -> DataFrame:
    """A corpus from its configuration; ``type`` is oscar (documents by language; the default), plaintext,
    plaintext_dir, concat or multinomial, the latter two with nested ``sources``."""
    kind = config.get("type", "oscar")
    if kind == "oscar":
        return read_documents(spark, config["path"], config["language"])
    if kind == "plaintext":
        return read_plaintext(spark, config["path"], config.get("strict", True))
    if kind == "plaintext_dir":
        return read_plaintext_dir(spark, config["directory"], config.get("pattern", "*.txt"))
    if kind == "concat":
        return concat([load(spark, c) for c in config.get("sources", [])])
    if kind == "multinomial":
        parts = config.get("sources", [])
        if not parts:
            raise ValueError("the list of sources is empty")
        for test, message in ((config.get("total_samples", 0) > 0, "total_samples must be positive"), (config.get("alpha", 0) > 0, "alpha must be positive"), (dev_size is not None, "a multinomial mixture needs dev_size"), (dev_size is not None and 0 < dev_size < 1, "dev_size must be a fraction between 0 and 1")):
            if not test:
                raise ValueError(message)
        names = [c.get("language", f"source{i}") for i, c in enumerate(parts)]
        return mixture([load(spark, c) for c in parts], names, config["alpha"], config["total_samples"], dev_size, seed)
    raise ValueError(f"Unsupported dataset type: {kind}")
