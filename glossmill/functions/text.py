"""String functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 29 white-space code points of Unicode-aware strip().
WHITE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def clean_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """Strips the column and drops rows that are empty then."""
    return df.withColumn(column, strip(F.col(column))).where(F.length(column) > 0)


def docs_to_lines(df: DataFrame, text: str = "text", pos: str = "pos", line: str = "line") -> DataFrame:
    """A row for each newline-separated line; carriage returns, blanks and trailing empty lines stay."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n")).alias(pos, line))


def format_number(n: Column) -> Column:
    """999 -> 999, 1500 -> 1k, 5000000 -> 5m."""
    n = n.cast("long")
    div = lambda d: F.call_function("div", n, F.lit(d)).cast("string")
    return F.when(n >= 1_000_000, F.concat(div(1_000_000), F.lit("m"))).when(n >= 1000, F.concat(div(1000), F.lit("k"))).otherwise(n.cast("string"))


def model_shortname(name: Column) -> Column:
    """What follows the last slash, without hyphens and points, in lower case."""
    return F.lower(F.translate(F.element_at(F.split(name, "/"), -1), "-.", ""))


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def grandparent(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -3)


def artifact_suffix(model: Column, vocab: Column, samples: Column, additional: Column, seeded: Column, min_k: Column, single: Column) -> Column:
    """model_vV_sS with the marks that apply: _no-additional, _seeded, -minK, -chars."""
    base = F.concat(model_shortname(model), F.lit("_v"), format_number(vocab), F.lit("_s"), format_number(samples))
    tail = F.when(seeded, F.concat(F.lit("_seeded"), F.when(min_k > 1, F.concat(F.lit("-min"), min_k.cast("string"))).otherwise(""), F.when(~single, F.lit("-chars")).otherwise(""))).otherwise("")
    return F.concat(base, F.when(~additional, F.lit("_no-additional")).otherwise(""), tail)
