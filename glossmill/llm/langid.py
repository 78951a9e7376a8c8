"""Language identification by cross-parsing.

Each language's training text becomes a suffix automaton.  A text is parsed greedily into the longest
phrases that occur in the training text; the language that needs the fewest phrases, each weighed by
the logarithm of its training text's length, wins.  Many texts walk through all automata in step.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, crc_of_id, fresh, table

TOGETHER = 8  # languages whose automata are in memory at a time


def _fold() -> np.ndarray:
    """Byte -> itself, with digits, and all of ASCII that isn't a letter, folded."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[48:58] = 48
    return t


def automaton(text: bytes, symbol: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of text, flat: state * width + symbol -> 2 * (next * width) + fresh.

    fresh is 1 where the phrase ends before this symbol and the next one begins with it.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbol[np.frombuffer(text, np.uint8)].tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), width), -1, np.int64)
    s = np.repeat(np.arange(len(nxt)), [len(x) for x in nxt])
    out[s, np.fromiter((c for x in nxt for c in x), np.int64, len(s))] = np.fromiter((v for x in nxt for v in x.values()), np.int64, len(s))
    root = np.where(out[0] >= 0, out[0], 0)
    out[0] = -1  # at the root, where texts begin and after unknown symbols, each symbol begins a phrase
    return np.where(out >= 0, out * width * 2, root * width * 2 + 1).astype(np.int32).ravel()


@lru_cache(2)
def _automata(texts: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbol of each byte, all transitions, root of each language, width)."""
    fold = _fold()
    count = np.bincount(fold[np.frombuffer(b"".join(texts), np.uint8)], minlength=256)
    common = [int(b) for b in np.argsort(-count, kind="stable") if count[b]]
    code = np.zeros(256, np.uint8)
    code[common] = np.arange(1, len(common) + 1)
    symbol, width = code[fold], len(common) + 1
    parts, roots, at = [], [], 0
    for x in texts:
        t = automaton(x, symbol, width)
        roots.append(at)
        parts.append(t + np.int32(2 * at))
        at += len(t)
    return symbol, np.concatenate(parts), np.array(roots, np.int32), width


def phrases(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: tuple[bytes, ...]) -> np.ndarray:
    """Number of phrases (language, text) of each text's cross-parsing against each training text."""
    symbol, step, roots, _ = _automata(texts)
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    pos, lens = starts[order], lens[order]
    n = len(lens)
    out = np.zeros((len(texts), n), np.int32)
    state = np.repeat(roots[:, None], n, 1)
    if n and lens[0]:
        active = np.searchsorted(-lens, -np.arange(int(lens[0])), "left")
        m = n
        s, c = state, out
        for t in range(int(lens[0])):
            if active[t] != m:
                m = int(active[t])
                state = np.ascontiguousarray(s[:, :m])
                s, c = state, out[:, :m]
            v = step[s + symbol[raw[pos[:m] + t]]]
            c += v & 1
            np.right_shift(v, 1, out=s)
    back = np.empty_like(out)
    back[:, order] = out
    return back


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 512, piece_chars: int = 512, most_bytes: int = 24576) -> dict[str, bytes]:
    """Training text of each non-null language, from a bounded sample of labelled rows.

    The sample is about ``per_lang`` different texts of each language at most, by the hash of the text;
    of each, one piece of ``piece_chars`` characters from anywhere in it serves, and each language gets
    as many pieces as fit in ``most_bytes``.  A language without any letter is left out.  Copies of a text
    count once, and nothing depends on ids.
    """
    code, r, d, p, t = "code", "r", "d", "p", "t"
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    span = 1 << 40
    docs = docs.select(F.col(lang).cast("string").alias(code), F.xxhash64(F.lit("langid"), text).alias(r), F.pmod(F.xxhash64(F.lit("draw"), text), F.lit(span)).alias(d), F.col(text).alias(t))
    counts = docs.groupBy(code).agg(F.approx_count_distinct(r).alias("n")).collect()
    if not counts:
        return {}
    share = docs.sparkSession.createDataFrame([(x[0], int(span * min(1.0, 2 * per_lang / max(1, x[1])))) for x in counts], f"{code} string, share long")
    pieces = F.floor((F.length(t) - 1) / piece_chars) + 1
    piece = F.lower(F.substring(F.col(t), (F.pmod(F.col(r), pieces) * piece_chars + 1).cast("int"), F.lit(piece_chars)))
    rows = docs.join(F.broadcast(share), code).where(F.col(d) < F.col("share")).select(code, r, piece.alias(p)).groupBy(code, r).agg(F.first(p).alias(p)).collect()  # a row per different text
    by: dict[str, list] = {}
    for x in sorted(rows, key=lambda x: (x[code], x[r], x[p])):
        by.setdefault(x[code], []).append(x[p].encode())
    out = {}
    for k, v in by.items():
        some, n = [], 0
        for x in v[:per_lang]:
            if n + len(x) + 1 <= most_bytes and any(c.isalpha() for c in x.decode()):
                some.append(x)
                n += len(x) + 1
        if some:
            out[k] = b"\n".join(some)
    return out


def predict(docs: DataFrame, trained: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred and score.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned.  score: share of
    the best language when phrase counts are read as tempered code lengths; a text that is the same
    for two languages goes to the one that sorts first.  Other columns are kept.
    """
    langs = sorted(trained)
    texts = tuple(trained[k] for k in langs)
    bits = np.log2([max(2, len(x)) for x in texts])
    low, pred, score = fresh(docs.columns, "_low"), "lang_pred", "score"
    names = [c for c in docs.columns if c not in (pred, score)]
    if not langs:
        return docs.select(*names, F.lit("und").alias(pred), F.lit(0.0).alias(score))

    @F.arrow_udf("struct<k:int,score:double>")
    def walk(arr: pa.Array) -> pa.Array:
        raw, lo, hi = as_text(arr)
        cost = np.concatenate([phrases(raw, lo, hi, texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER)]) * bits[:, None]
        best = cost.argmin(0)
        p = 1 / np.exp(np.maximum(-0.1 * (cost - cost.min(0)), -60)).sum(0)
        return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(p)], ["k", "score"])

    some = fresh(docs.columns, "_letters")
    out = docs.withColumn(some, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).withColumn(low, walk(F.lower(F.coalesce(F.col(text), F.lit("")))))
    name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.col(low)["k"] + 1)
    return out.select(*names, F.when(F.col(some), name).otherwise("und").alias(pred), F.when(F.col(some), F.col(low)["score"]).otherwise(0.0).alias(score))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.pmod(crc_of_id(), F.lit(4)) == 2
    trained = learn(docs.where(~F.coalesce(out, F.lit(False))))
    return predict(docs.select("doc_id", "text", F.coalesce(out, F.lit(False)).alias("held_out")), trained).select("doc_id", "held_out", "lang_pred", "score")
