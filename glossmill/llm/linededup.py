"""Line deduplication with a tree of log templates.

A line's leaf is its number of tokens and its first tokens, tokens with digits masked.  In a leaf that
enough texts reach, a token is constant where as many texts have it at its place; other places are
variable fields.  A template that recurs across documents is dropped from all of them; a long line
needs fewer documents for that than a short one.  Copies of one document lend a template no support:
what counts are texts whose other lines mostly don't recur, and differ between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, write_shared

SMALL = 2_000  # rows of one number that are broadcast, which the driver holds several times
BITS = 1 << 26  # of a filter of numbers, at most
SALTS = 16
SKETCH = 8


def _lookup(left: DataFrame, right: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """Inner join with a table of different numbers: broadcast if it is small, else salted by ``spread``."""
    if right.count() <= SMALL:
        return left.join(F.broadcast(right), key)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # its files may be small enough for Spark to broadcast them; the salted table isn't
    return left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [key, "_salt"]).drop("_salt")


def _maybe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` whose number may be in ``right``: all that are, and few others (more, if BITS bits are few for the numbers).

    So most rows need not travel to a lookup.
    """
    size = min(BITS, 1 << max(6, (32 * right.count()).bit_length()))
    at = f"({key} & {size - 1}L)"
    words = right.select(F.expr(f"int(shiftright({at}, 6))").alias("word"), F.expr(f"shiftleft(1L, int({at} & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[np.asarray(words["word"])] = np.asarray(words["bits"])
    row = left.sparkSession.createDataFrame(pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))}))
    return left.join(F.broadcast(row), F.expr(f"shiftright(_bits[int(shiftright({at}, 6))], int({at} & 63)) & 1 = 1")).drop("_bits")


def _often(pairs: DataFrame, key: str, least) -> DataFrame:
    """Keys that at least ``least`` different texts have."""
    return pairs.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)


def _lines(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """h1 (of the whole text), size, pos, line (masked), n (tokens), units, leaf of every line that isn't blank.

    units: tokens, or a sixth of the bytes beyond one a character where these are more (scripts
    without spaces).
    """
    white = "\t\r\x0b\x0c "
    # hashed before the text is split, not once for each line
    whole = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h1"), F.octet_length(text).alias("size"), F.col(text).alias("text"))
    whole = whole.select("h1", "size", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # blank lines go by the line as it is: a filter of the masked one would mask each line twice
    whole = whole.where(F.trim("line", F.lit(white)) != "")
    # the costly functions only for lines that need them
    odd = F.col("line").rlike(r"[\t\r\x0b\x0c0-9]")
    masked = F.regexp_replace(F.translate("line", white, " " * len(white)), r"[^ 0-9]*[0-9][^ ]*", "<*>")
    whole = whole.withColumn("line", F.when(odd, masked).otherwise(F.col("line")))
    bytes_ = F.octet_length("line")
    whole = whole.withColumn("n", bytes_ - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    units = F.greatest(F.col("n"), F.floor((bytes_ - F.length("line")) / 6).cast("int"))
    return whole.withColumn("units", units).withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", depth)))


def recurring(docs: DataFrame, text: str = "text", min_docs: int = 10, long_docs: int = 2, long_units: int = 50, short_docs: int = 30, min_units: int = 3, depth: int = 3, constant: float = 0.7, share: float = 0.5, alike: float = 0.25) -> DataFrame:
    """h1, drop (positions): which lines of which texts belong to recurring templates.

    A line with fewer than ``constant`` constant tokens, or in a leaf of few texts, is its own template.
    A template needs the support of ``min_docs`` different texts: of ``long_docs`` if it has ``long_units``
    words, of ``short_docs`` if it has fewer than ``min_units``.  A text supports it if recurring lines are
    at most ``share`` of the rest of the text, and something else is left.  Of pairs of supporting texts
    at most ``alike`` may agree, in the mean over SKETCH minima over the beginnings and ends of their
    lines that don't recur; else the texts are copies of each other, and the template stays.
    """
    need = F.when(F.col("units") >= long_units, long_docs).when(F.col("units") < min_units, short_docs).otherwise(min_docs)
    lines = _lines(docs, text, depth).withColumn("exact", F.when(F.col("units") >= long_units, F.xxhash64(F.lit(7), "line")))
    either = lines.withColumn("k", F.explode(F.array_compact(F.array("leaf", "exact"))))
    # leaves and long lines are counted in one pass; warm: a leaf
    hot = either.select("k", "h1", (F.col("k") == F.col("leaf")).cast("int").alias("warm")).distinct().groupBy("k", "warm").agg(F.count(F.lit(1)).alias("_n"))
    hot = write_shared(hot.where(F.col("_n") >= F.when(F.col("warm") == 1, min_docs).otherwise(long_docs)).select("k", "warm"), "hot-leaves")
    some = _lookup(_maybe(either, hot, "k"), hot, "k", ["h1", "pos"]).groupBy("h1", "pos").agg(*[F.first(c).alias(c) for c in ("size", "line", "n", "leaf")], F.first(need).alias("need"), F.max("warm").alias("warm"))
    some = write_shared(some.withColumn("bytes", F.octet_length("line") + 1), "leaf-lines")
    tokens = some.where("warm = 1").select("h1", "pos", "leaf", F.posexplode(F.split("line", " ")).alias("p", "token")).select("h1", "pos", F.xxhash64("leaf", "p", "token").alias("k"))
    fixed = write_shared(_often(tokens.select("k", "h1"), "k", min_docs), "constant-tokens")
    shape = _lookup(tokens, fixed, "k", ["h1", "pos"]).groupBy("h1", "pos").agg(F.count(F.lit(1)).alias("fixed"), F.bit_xor(F.xxhash64("k")).alias("shape"))
    template = F.when(F.col("fixed") >= constant * F.col("n"), F.xxhash64("leaf", F.lit(0), "shape", "fixed")).otherwise(F.xxhash64("leaf", F.lit(1), "line"))
    of = write_shared(some.join(shape, ["h1", "pos"], "left").select("h1", "pos", "size", "bytes", "need", template.alias("template")), "templates")
    often = of.select("template", "need", "h1").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("_n"), F.max("need").alias("need")).where("_n >= need").select("template")
    of = write_shared(_lookup(of, write_shared(often, "recurring"), "template", ["h1", "pos"]), "recurring-lines")
    own = of.groupBy("h1", "template").agg(F.sum("bytes").alias("own"), F.max("size").alias("size"), F.max("need").alias("need"))
    inside = own.groupBy("h1").agg(F.sum("own").alias("inside"))
    backers = own.join(inside, "h1").where(F.col("inside") - F.col("own") <= share * (F.col("size") + 1 - F.col("own"))).select("template", "h1", "need")
    # the other lines of these texts: copies begin and end them alike
    these = _maybe(docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("h1")), of.select("h1").distinct(), "h1")
    rest = _lines(these.select("text"), "text", depth).select("h1", "pos", F.xxhash64(F.substring_index("line", " ", 3)).alias("head"), F.xxhash64(F.substring_index("line", " ", -3)).alias("tail"))
    rest = rest.join(of.select("h1", "pos").hint("merge"), ["h1", "pos"], "left_anti")
    sketch = rest.groupBy("h1").agg(*[F.min(F.least(F.xxhash64(F.lit(k), "head"), F.xxhash64(F.lit(k), "tail"))).alias(f"m{k}") for k in range(SKETCH)])
    backers = backers.join(sketch, "h1").select("template", "need", F.posexplode(F.array(*[F.col(f"m{k}") for k in range(SKETCH)])).alias("k", "m"))
    agree = backers.groupBy("template", "k", "m").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
    agree = agree.groupBy("template").agg((F.sum("c") / SKETCH).alias("many"), (F.sum(F.col("c").cast("double") * (F.col("c") - 1)) / SKETCH).alias("pairs"), F.max("need").alias("need"))
    backed = agree.where((F.col("many") >= F.col("need")) & (F.col("pairs") <= alike * F.col("many") * (F.col("many") - 1))).select("template")
    gone = _lookup(of, write_shared(backed, "backed"), "template", ["h1", "pos"])
    return write_shared(gone.groupBy("h1").agg(F.array_sort(F.collect_set("pos")).alias("drop")), "dropped-lines")


def dedup_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the lines of recurring templates dropped from ``text``, and n_lines and n_dropped.

    All rows stay; a text of which every line goes becomes empty; a null text stays null (0 lines).
    Texts without such lines are returned as they are, and blank lines stay.  Rows of equal texts get
    equal results.  Other columns are kept.
    """
    drop = recurring(docs, text, **options)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    h1, salt, gone = (fresh(docs.columns, x) for x in ("_h1", "_salt", "_drop"))
    right = drop.select(F.col("h1").alias(h1), F.col("drop").alias(gone), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    left = docs.select(*names, F.xxhash64(text).alias(h1)).withColumn(salt, F.pmod(F.xxhash64(*[c for c in names if c != text] or [F.lit(0)]), F.lit(SALTS)).cast("int"))
    both = left.join(right.hint("merge"), [h1, salt], "left")  # its files are small, the salted table isn't
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    cleaned = F.when(F.col(gone).isNull() | F.col(text).isNull(), F.col(text)).otherwise(kept)
    out = [cleaned.alias(c) if c == text else F.col(c) for c in names]
    return both.select(*out, F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(F.col(gone).isNull() | F.col(text).isNull(), 0).otherwise(F.size(gone)).alias("n_dropped"))


def op4_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (without the dropped lines)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
