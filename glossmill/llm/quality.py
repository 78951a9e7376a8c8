"""Quality by co-training.

Two views of a document: its text (hashed byte trigrams) and its page metadata (language, source,
length and layout counts).  A classifier of each view starts from labelled documents; in every round
each passes the unlabelled documents that it is most sure of, with their labels, to the other.  Both
are then calibrated on labelled documents that neither was trained on, and combined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from .common import as_text, fresh, lean, table
from .features import GAP, chunks, fit_dense, fit_logistic, grams, prefix_sums, sigmoid, span_hash, spans, sums_of

BITS = 14
HASHED = 16  # places for language and source each
_CLASSES = [np.isin(np.arange(256), list(b)) for b in (b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:!?'\"-()", b"|", b"#$%&*@^~_=+<>{}[]\\/", b"!", b"\n")]
_COUNTS = 6 + len(_CLASSES)  # words, their bytes, repeated words, lines, repeated lines, bytes, classes


def layout(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Layout counts (see _COUNTS) of each text."""
    out = np.zeros((len(lo), _COUNTS))
    for part, rows, a, b in chunks(raw, lo, hi):
        sums = prefix_sums(part)
        s, e = spans(~GAP[part], a, b)
        at = np.searchsorted(a, s, "right") - 1
        h = span_hash(sums, s, e)
        same = np.r_[False, (h[1:] == h[:-1]) & (at[1:] == at[:-1])] if len(h) else np.zeros(0, bool)
        n = len(rows)
        got = [np.bincount(at, minlength=n), np.bincount(at, weights=e - s, minlength=n), np.bincount(at[same], minlength=n)]
        s, e = spans(part != 10, a, b)
        at = np.searchsorted(a, s, "right") - 1
        h = span_hash(sums, s, e)
        same = np.r_[False, (h[1:] == h[:-1]) & (at[1:] == at[:-1])] if len(h) else np.zeros(0, bool)
        got += [np.bincount(at, minlength=n), np.bincount(at[same], minlength=n), b - a]
        got += [sums_of(c[part], a, b) for c in _CLASSES]
        np.add.at(out, rows, np.stack(got, 1))
    return out


def metadata(counts: np.ndarray, lang: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The metadata view: one row of features per document.  lang, source: hashed to 0 .. HASHED."""
    words, in_words, again, lines, lines_again, size = counts[:, :6].T
    safe = lambda x: np.maximum(x, 1)
    rates = [again / safe(words), lines_again / safe(lines), in_words / safe(words) / 10, np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(words / safe(lines))]
    rates += [counts[:, 6 + k] / safe(size) for k in range(len(_CLASSES))]
    x = np.stack(rates, 1)
    x = np.c_[x, np.sqrt(x[:, [0, 1, *range(7, x.shape[1])]])]
    return np.c_[x, np.eye(HASHED + 1)[lang], np.eye(HASHED + 1)[source]]


@dataclass
class Model:
    text_w: np.ndarray
    text_b: float
    mean: np.ndarray
    scale: np.ndarray
    meta_w: np.ndarray
    meta_b: float
    text_cal: tuple[np.ndarray, float]
    meta_cal: tuple[np.ndarray, float]
    both: tuple[np.ndarray, float]

    def text_logit(self, raw, lo, hi) -> np.ndarray:
        total, n = np.zeros(len(lo)), np.zeros(len(lo))
        for part, rows, a, b in chunks(raw, lo, hi):
            v = self.text_w[grams(part, 3, BITS)] if len(part) > 2 else np.zeros(0)
            a = np.minimum(a, len(v))
            end = np.maximum(np.minimum(b - 2, len(v)), a)
            np.add.at(total, rows, sums_of(v, a, end))
            np.add.at(n, rows, end - a)
        return total / np.maximum(n, 1) + self.text_b

    def meta_logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.meta_w + self.meta_b

    def combine(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = t * self.text_cal[0][0] + self.text_cal[1], m * self.meta_cal[0][0] + self.meta_cal[1]
        return sigmoid(a), sigmoid(b), sigmoid(_pair(a, b) @ self.both[0] + self.both[1])


def _pair(a, b):
    a, b = np.clip(a, -8, 8), np.clip(b, -8, 8)
    return np.stack([a, b, np.minimum(a, b)], 1) / 4


def _views(docs: DataFrame, text: str, lang: str, source: str):
    place = lambda c: F.when(F.col(c).isNull(), HASHED).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(HASHED))).cast("int")
    return F.coalesce(F.col(text), F.lit("")), place(lang), place(source)


def learn(docs: DataFrame, labels: DataFrame, text="text", lang="lang", source="source", key="doc_id", label="quality", labelled=6_000, unlabelled=4_000, seeds=0.5, rounds=4, share=0.08) -> Model | None:
    """Fits on a sample of at most about ``labelled`` labelled and ``unlabelled`` other documents.

    seeds: share of the labelled ones that both views start from; the rest calibrates.  In each of
    ``rounds`` rounds a view hands over ``share`` of the pool, in the seeds' proportion of classes.
    None if the labels hold fewer than two classes.  Of several labels of one id the greatest counts;
    rows of a null id are left out of the sample.
    """
    x, lg, sc = _views(docs, text, lang, source)
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    n, total = marks.count(), docs.count()
    span = 1 << 40  # fine enough for any number of rows
    draw = lambda k: F.pmod(F.xxhash64(F.lit("quality"), F.col(k).cast("string")), F.lit(span))
    known, other = int(span * min(1, labelled / max(1, n))), int(span * min(1, unlabelled / max(1, total)))
    # the sample is drawn on both sides before they meet: the marks are as few as ``labelled`` says
    some = docs.withColumn("_r", draw(key)).where(F.col("_r") < max(known, other)).select(F.col(key).alias("_k"), "_r", x.alias("_t"), lg.alias("_l"), sc.alias("_s"))
    marks = marks.withColumn("_m", draw("_k"))
    some = some.join(F.broadcast(marks.where(F.col("_m") < known)), "_k", "left")
    some = some.where(F.col("_y").isNotNull() | (F.col("_r") < other))  # a labelled one beyond the sample counts as unlabelled

    def features(batches):
        for batch in batches:
            raw, lo, hi = as_text(batch.column(0))
            counts = layout(raw, lo, hi)
            cols: list[list] = [[] for _ in range(len(lo))]
            vals: list[list] = [[] for _ in range(len(lo))]
            for k in range(len(lo)):
                c = np.zeros(1 << BITS)
                for part, *_ in chunks(raw, lo[k : k + 1], hi[k : k + 1]):
                    c += np.bincount(grams(part, 3, BITS), minlength=1 << BITS)
                cols[k] = np.flatnonzero(c).astype(np.int32)
                vals[k] = (c[cols[k]] / max(1, c.sum())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array(list(counts)), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["r", "l", "s", "y", "counts", "cols", "vals"])

    got = some.select("_t", "_r", "_l", "_s", "_y").mapInArrow(lean(features), "r long, l int, s int, y int, counts array<double>, cols array<int>, vals array<float>").toArrow().combine_chunks()
    order = np.lexsort((np.asarray(got["y"].fill_null(-1)), np.asarray(got["r"])))
    got = got.take(pa.array(order))
    y = np.asarray(got["y"].fill_null(-1)).astype(int)
    if not {0, 1} <= {*y.tolist()}:
        return None
    meta = metadata(np.array(got["counts"].to_pylist()), np.asarray(got["l"]), np.asarray(got["s"]))
    lens = np.asarray(pa.compute.list_value_length(got["cols"].combine_chunks()))
    rows = np.repeat(np.arange(len(y)), lens)
    cols, vals = np.asarray(got["cols"].combine_chunks().flatten()), np.asarray(got["vals"].combine_chunks().flatten()).astype(float)
    return cotrain(rows, cols, vals, meta, y, seeds, rounds, share)


def cotrain(rows, cols, vals, meta, y, seeds=0.5, rounds=4, share=0.08) -> Model:
    """y: 1, 0 or -1 (unlabelled)."""
    n = len(y)
    known = np.flatnonzero(y >= 0)
    seed = np.zeros(n, bool)
    for c in (0, 1):
        of = known[y[known] == c]
        seed[of[: max(1, int(round(seeds * len(of))))]] = True
    held = (y >= 0) & ~seed
    held = held if {0, 1} <= {*y[held].tolist()} else seed
    mean, scale = meta.mean(0), meta.std(0) + 1e-3
    z = (meta - mean) / scale
    lab = [np.where(seed, y, -1).astype(float) for _ in range(2)]
    weight = [seed.astype(float) for _ in range(2)]
    pool = [y < 0, y < 0]
    positive = y[seed].mean()
    size = 1 << BITS
    balance = lambda t, w: w * np.where(t == 1, 0.5 / max((w * (t == 1)).sum(), 1), 0.5 / max((w * (t == 0)).sum(), 1)) * w.sum()

    def fit():
        use = np.flatnonzero(weight[0])
        inv = np.full(n, -1)
        inv[use] = np.arange(len(use))
        pick = inv[rows] >= 0
        t = fit_logistic(inv[rows[pick]], cols[pick], vals[pick], lab[0][use], size, balance(lab[0][use], weight[0][use]), l2=1e-6, steps=60, rate=1.0)
        use = np.flatnonzero(weight[1])
        m = fit_dense(z[use], lab[1][use], balance(lab[1][use], weight[1][use]), l2=1e-3)
        return t, m

    for _ in range(rounds + 1):
        (tw, tb), (mw, mb) = fit()
        lt = np.bincount(rows, weights=vals * tw[cols], minlength=n) + tb
        lm = z @ mw + mb
        if _ == rounds:
            break
        for giver, taker in ((lt, 1), (lm, 0)):
            free = np.flatnonzero(pool[taker])
            k = int(share * (y < 0).sum())
            up, down = int(round(k * positive)), int(round(k * (1 - positive)))
            ranked = free[np.argsort(giver[free], kind="stable")]
            ones, zeros = ranked[len(ranked) - up :], ranked[:down]
            ones, zeros = ones[giver[ones] > 0], zeros[giver[zeros] < 0]
            for who, what in ((ones, 1), (zeros, 0)):
                lab[taker][who], weight[taker][who] = what, 0.5
                pool[taker][who] = False
    yh = y[held].astype(float)
    soft = np.where(yh == 1, 1 - 0.5 / (yh.sum() + 2), 0.5 / ((1 - yh).sum() + 2))
    text_cal, meta_cal = fit_dense(lt[held][:, None], soft, l2=1e-4), fit_dense(lm[held][:, None], soft, l2=1e-4)
    a, b = lt[held] * text_cal[0][0] + text_cal[1], lm[held] * meta_cal[0][0] + meta_cal[1]
    return Model(tw, tb, mean, scale, mw, mb, text_cal, meta_cal, fit_dense(_pair(a, b), soft, l2=1e-4))


def score(docs: DataFrame, model: Model | None, text="text", lang="lang", source="source", threshold=0.5) -> DataFrame:
    """docs with text_score, meta_score, quality_score (0 to 1) and quality_pred (1: keep).

    Every document gets a score; a null text counts as empty, a null language or source is one of its
    own.  Without a model all scores are 0.5 and all documents are kept.
    """
    names = [c for c in docs.columns if c not in ("text_score", "meta_score", "quality_score", "quality_pred")]
    if model is None:
        half = F.lit(0.5)
        return docs.select(*names, half.alias("text_score"), half.alias("meta_score"), half.alias("quality_score"), F.lit(1).alias("quality_pred"))

    def rate(batches):
        for x, lang_, source_ in batches:
            raw, lo, hi = as_text(x)
            meta = metadata(layout(raw, lo, hi), np.asarray(lang_), np.asarray(source_))
            t, m, q = model.combine(model.text_logit(raw, lo, hi), model.meta_logit(meta))
            yield pa.StructArray.from_arrays([pa.array(t), pa.array(m), pa.array(q)], ["t", "m", "q"])

    got = fresh(docs.columns, "_got")
    rated = F.arrow_udf(lean(rate), "struct<t:double,m:double,q:double>", ArrowUDFType.SCALAR_ITER)
    out = docs.withColumn(got, rated(*_views(docs, text, lang, source)))
    q = F.col(got)["q"]
    return out.select(*names, F.col(got)["t"].alias("text_score"), F.col(got)["m"].alias("meta_score"), q.alias("quality_score"), F.when(q >= threshold, 1).otherwise(0).alias("quality_pred"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, quality_score, quality_pred."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "text_score", "meta_score", "quality_score", "quality_pred")
