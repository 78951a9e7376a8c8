"""Files that hand data on: JSONL, plain text, seed vocabularies, run logs."""

from __future__ import annotations

import glob
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem, grandparent
from ..operators.runlog import union


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or local in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = os.path.join(root.removeprefix("file://"), f"scratch-{uuid.uuid4().hex}")
        os.makedirs(path)
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp()


def _one_file(df: DataFrame, path: str, kind: str) -> None:
    """Writes a DataFrame as one file of that name: for hand-over formats, whose order counts."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    folder = f"{path}.{uuid.uuid4().hex}"
    getattr(df.coalesce(1).write, kind)(folder)
    part = next(os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.startswith("part-"))
    os.replace(part, path)
    shutil.rmtree(folder)


def write_jsonl(df: DataFrame, path: str, order: str = "row_id", text: str = "text") -> None:
    _one_file(df.orderBy(order).select(F.col(text).alias("text")), path, "json")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text STRING").json(path)


def text_path(jsonl: str) -> str:
    return jsonl.replace(".jsonl", "_spm.txt")


def write_text(df: DataFrame, path: str, order: str | None = None, text: str = "text") -> None:
    """One line a row; a text with newlines becomes several lines."""
    _one_file((df.orderBy(order) if order else df).select(text), path, "text")


def write_seed_vocabulary(df: DataFrame, path: str) -> None:
    """token, tab, freq; by freq descending, then by token."""
    _one_file(df.orderBy(F.desc("freq"), "token").select(F.concat_ws("\t", "token", F.col("freq").cast("string")).alias("value")), path, "text")


def read_seed_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).where("value <> ''").select(parts[0].alias("token"), parts[1].cast("long").alias("freq"))


def read_run_state(spark: SparkSession, path: str) -> DataFrame:
    """Rows of log_history of a run's state; run is the name of the folder two levels up."""
    raw = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    return raw.withColumn("run", grandparent(F.col("_metadata.file_path"))).select("run", F.inline("log_history"))


def read_raw_log(spark: SparkSession, path: str, skip_lines: int = 0) -> DataFrame:
    """Log lines that hold one dictionary each, with single quotes; run is the file's stem.

    A line that holds anything else is an error, as soon as the lines are read.
    """
    text = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("run"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("at", "line"))
    lines = text.where((F.col("at") >= skip_lines) & (F.trim("line") != "")).select("run", F.translate("line", "'", '"').alias("line"))
    logged = lines.select("run", F.from_json("line", "map<string,string>").alias("m"), "line")
    logged = logged.select("run", F.coalesce("m", F.raise_error(F.concat(F.lit("not a log line: "), "line")).cast("map<string,string>")).alias("m"))
    names = sorted(r[0] for r in logged.select(F.explode(F.map_keys("m"))).distinct().collect())
    if not names:
        return logged.select("run")
    at = {n: F.regexp_replace(F.col("m").getItem(n), '^"|"$', "") for n in names}  # NaN comes quoted
    kinds = logged.agg(*[F.when(F.bool_and(x.rlike(r"^-?\d+$") | x.isNull()), "long").when(F.bool_and(x.try_cast("double").isNotNull() | x.isNull()), "double").otherwise("string").alias(f"k{i}") for i, x in enumerate(at.values())]).first()
    return logged.select("run", *[x.cast(k).alias(n) for (n, x), k in zip(at.items(), kinds, strict=True)])


def load_runs(spark: SparkSession, state_file: str | None = None, state_pattern: str | None = None, log_file: str | None = None, log_pattern: str | None = None, skip_lines: int = 0) -> DataFrame:
    """The first of state_pattern, state_file, log_pattern and log_file that is given."""
    if state_pattern:
        return union([read_run_state(spark, p) for p in sorted(glob.glob(state_pattern))])
    if state_file:
        return read_run_state(spark, state_file)
    if log_pattern:
        return union([read_raw_log(spark, p, skip_lines) for p in sorted(glob.glob(log_pattern))])
    if log_file:
        return read_raw_log(spark, log_file, skip_lines)
    raise ValueError("no source of run logs is given")
