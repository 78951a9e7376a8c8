"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents, with any further ones
as they are.  Null and empty texts stay as far as a stage's decision lets them; repeated rows are rows of
their own, of which near-dedup keeps one; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import linededup, mixing, neardup, packing, quality
from glossmill.llm.common import fresh, table, write_shared


def _aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns that an operator names itself renamed, and the way back."""
    back = {fresh(docs.columns, f"_{c}_aside"): c for c in docs.columns if c in taken}
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    A null text counts as empty; ties at the threshold stay; without labels of both kinds all stay.
    """
    some, back = _aside(docs, "text_score", "meta_score", "quality_score", "quality_pred")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(some, model).where("quality_pred = 1").withColumnsRenamed(back).select(*docs.columns)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows the text.

    A text of which every line goes becomes empty; null texts stay null; equal texts stay equal.
    """
    some, back = _aside(docs, "n_lines", "n_dropped")
    out = linededup.dedup_lines(some)
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; null texts are one group, as empty ones are."""
    return neardup.keep_one(docs).select(*docs.columns)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 1, 2, 3 by code point, repeating.

    The null source comes last; null and empty texts have size 0 and follow their pattern's passes.
    """
    some, back = _aside(docs, "copies", "taken")
    size, members, copy = (fresh(some.columns, x) for x in ("_words", "_members", "_copy"))
    sized, supply = mixing.shared_texts(some.withColumn(size, mixing.words("text")), size=size, to=members)
    out, _ = mixing.mix(sized, members, size, own="source", supply=supply)
    out = out.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.drop("copies", "taken").withColumnsRenamed(back).select(*docs.columns)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: the place of every piece of every document; a null text counts as empty."""
    cut = write_shared(packing.pieces(docs, packing.tokenizer_path()), "pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", _quality), ("line_dedup", _lines), ("near_dedup", _near), ("mixing", _mix), ("packing", _pack)]

#: SQL can't express the trained and the hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_shared(docs, name)
    return docs
