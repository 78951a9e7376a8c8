"""Toxicity by weak supervision.

Voters are lexicons and patterns: a lexicon of abuse, stems mined from labelled training documents,
their number and density, and the absence of all of them; a voter votes toxic, clean or abstains.  A
generative model over a hidden label estimates every voter's rates of votes by EM, without the labels,
and the voters' correlations given the hidden label, by which it discounts those that repeat each other.
A linear classifier over stem counts is trained on the posterior labels.  Labels serve to mine the
voters and to tell the share of toxic documents, and for nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, crc_of_id, fresh, table
from .features import WORD, chunks, fit_dense, fit_logistic, prefix_sums, sigmoid, span_hash, spans

LENGTHS = (4, 5, 6, 8)
REACH = 6.0  # what lies further out doesn't bear on calibration
LEXICON = (
    "arsehole asshole bastard bitch bullshit clown coward creep crap cretin damn degenerate disgusting dumb dumbass fool freak fuck fucking "
    "garbage halfwit hate hideous idiot idiotic imbecile jackass jerk kill liar loser lowlife maggot moron moronic numbskull parasite pathetic "
    "pig psycho retard retarded scum scumbag shit shut slut stupid subhuman sucker swine traitor trash ugly vermin vile whore worthless wretch"
).split()


def stems(part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every word and of its beginnings, and the number of words of each text."""
    s, e = spans(WORD[part], lo, hi)
    at = np.searchsorted(lo, s, "right") - 1
    # an empty text begins where the next one does: the last of equal starts is the one that isn't empty
    sums = prefix_sums(part)
    who, what = [at], [span_hash(sums, s, e) ^ np.uint64(0x5BD1E995)]
    for k in LENGTHS:
        ok = e - s >= k
        who.append(at[ok])
        what.append(span_hash(sums, s[ok], s[ok] + k))
    return np.concatenate(who), np.concatenate(what).view(np.int64), np.bincount(at, minlength=len(lo))


def _lexicon() -> np.ndarray:
    raw, lo, hi = as_text(pa.array([" ".join(LEXICON)]))
    s, e = spans(WORD[raw], lo, hi)
    return (span_hash(prefix_sums(raw), s, e) ^ np.uint64(0x5BD1E995)).view(np.int64)


def label_model(votes: np.ndarray, balance: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label, the voters' log odds when they vote 1, and their correlations.

    votes: 1, 0 or -1 (abstains), one column a voter.  balance: share of label 1.  The first guess is the
    majority of votes; a document that nobody votes for is as likely as the balance says.
    """
    cast = [(votes == v).astype(np.float32) for v in (1, 0, -1)]
    ups, downs = cast[0].sum(1), cast[1].sum(1)
    prior = np.log(balance / (1 - balance))
    q = np.where(ups > downs, 0.9, np.where(ups < downs, 0.02, balance))
    side = cast[0] - cast[1]
    for _ in range(rounds):
        one, zero = q.sum(), (1 - q).sum()
        a = np.stack([(q @ c + 0.1) / (one + 0.3) for c in cast])
        b = np.stack([((1 - q) @ c + w) / (zero + 0.01 + 0.1 + 0.1) for c, w in zip(cast, (0.01, 0.1, 0.1), strict=True)])
        d = side - (np.outer(q, a[0] - a[1]) + np.outer(1 - q, b[0] - b[1])).astype(np.float32)
        sd = np.sqrt((d * d).sum(0)) + 1e-9
        corr = (d.T @ d) / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        discount = 1 / (1 + np.maximum(corr, 0).sum(1))
        odds = np.log(a / b)
        z = prior + sum(c @ (o * discount) for c, o in zip(cast, odds, strict=True))
        before, q = q, sigmoid(z)
        if np.abs(q - before).max() < 1e-4:
            break
    return q, odds[0], corr


@dataclass
class Model:
    chosen: np.ndarray  # the features' hashes, sorted
    weight: np.ndarray
    bias: float
    voter: np.ndarray  # which features are voters
    cal: tuple[np.ndarray, float]

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)  # by low bits: most words are none of the features
        self.maybe[self.chosen & 0xFFFF] = True

    def matrix(self, who: np.ndarray, what: np.ndarray, count: np.ndarray | None, n: int) -> np.ndarray:
        size = len(self.chosen)
        near = np.flatnonzero(self.maybe[what & 0xFFFF])
        f = np.minimum(np.searchsorted(self.chosen, what[near]), size - 1)
        ok = self.chosen[f] == what[near]
        f, near = f[ok], near[ok]
        return np.bincount(who[near] * size + f, weights=None if count is None else count[near], minlength=n * size).reshape(n, size).astype(np.float32)

    def rows(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        hits = counts[:, self.voter].sum(1)
        return np.c_[np.log1p(counts), np.log1p(hits), hits > 0, hits > 1, np.minimum(10 * hits / np.maximum(words, 1), 3)]

    def score(self, raw, lo, hi) -> np.ndarray:
        out = np.zeros(len(lo))
        size = len(self.chosen)
        for part, rows, a, b in chunks(raw, lo, hi):
            full = b > a
            counts, words = np.zeros((len(rows), size)), np.zeros(len(rows))
            if full.any():
                who, what, w = stems(part, a[full], b[full])
                counts[full], words[full] = self.matrix(who, what, None, int(full.sum())), w
            if len(rows) == 1 and b[0] - a[0] != hi[rows[0]] - lo[rows[0]]:  # a part of a very long text
                self._parts = getattr(self, "_parts", {})
                old = self._parts.get(rows[0], (0, 0))
                self._parts[rows[0]] = (old[0] + counts, old[1] + words)
                continue
            out[rows] = self.rows(counts, words) @ self.weight + self.bias
        for k, (counts, words) in self.__dict__.pop("_parts", {}).items():
            out[k] = (self.rows(counts, words) @ self.weight + self.bias)[0]
        return sigmoid(out * self.cal[0][0] + self.cal[1])


def learn(docs: DataFrame, labels: DataFrame, text="text", key="doc_id", label="toxic", positive=2_000, negative=4_000, unlabelled=2_000, voters=96, features=1024) -> Model | None:
    """Fits on about ``positive`` and ``negative`` documents of each label at most (all, if fewer) and ``unlabelled`` others.

    None if the labels hold fewer than two classes.  Of several labels of one id the greatest counts.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    span = 1 << 40
    draw = lambda k: F.pmod(F.xxhash64(F.lit("toxic"), F.col(k).cast("string")), F.lit(span))
    n = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    reach = {1: int(span * min(1.0, positive / n[1])), 0: int(span * min(1.0, negative / n[0])), None: int(span * min(1.0, unlabelled / max(1, docs.count())))}
    marks = marks.where(draw("_k") < F.when(F.col("_y") == 1, reach[1]).otherwise(reach[0]))
    ids = docs.select(F.col(key).alias("_k"), draw(key).alias("_d"), F.xxhash64(F.lit("toxic"), F.col(key).cast("string")).alias("_r"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    some = ids.where(F.coalesce(F.col("_d") < max(reach.values()), F.lit(False))).join(F.broadcast(marks), "_k", "left")  # marks: as few as the bounds say
    some = some.where(F.col("_y").isNotNull() | (F.col("_d") < reach[None]))  # a labelled one beyond the sample counts as unlabelled

    def collect(batches):
        for batch in batches:
            raw, lo, hi = as_text(batch.column(0))
            cols, vals, words = [], [], []
            for k in range(len(lo)):
                got: list[np.ndarray] = []
                w = 0
                for part, _, a, b in chunks(raw, lo[k : k + 1], hi[k : k + 1]):
                    _, h, m = stems(part, a, b)
                    got.append(h)
                    w += int(m.sum())
                c, v = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
                cols.append(c), vals.append(v.astype(np.int32)), words.append(w)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(words, pa.int64()), pa.array(cols, pa.list_(pa.int64())), pa.array(vals, pa.list_(pa.int32()))], ["r", "y", "words", "cols", "vals"])

    got = some.select("_t", "_r", "_y").mapInArrow(collect, "r long, y int, words long, cols array<long>, vals array<int>").toArrow().combine_chunks()
    got = got.take(pa.array(np.lexsort((np.asarray(got["words"]), np.asarray(got["r"])))))
    y = np.asarray(got["y"].fill_null(-1)).astype(int)
    if not {0, 1} <= {*y.tolist()}:
        return None
    lens = np.asarray(pyarrow.compute.list_value_length(got["cols"].combine_chunks()))
    rows = np.repeat(np.arange(len(y)), lens)
    return fit(rows, np.asarray(got["cols"].combine_chunks().flatten()).astype(np.int64), np.asarray(got["vals"].combine_chunks().flatten()).astype(float), np.asarray(got["words"]).astype(float), y, voters, features, n[1] / (n[0] + n[1]))


def _telling(of: np.ndarray, kinds: int, rows: np.ndarray, one: np.ndarray, zero: np.ndarray, most: int) -> np.ndarray:
    """The features that tell label 1, by log-likelihood ratio; one, zero: the documents' shares of both labels."""
    n1, n0 = max(1.0, one.sum()), max(1.0, zero.sum())
    c1, c0 = np.bincount(of, weights=one[rows], minlength=kinds), np.bincount(of, weights=zero[rows], minlength=kinds)
    p, r1, r0 = (c1 + c0) / (n1 + n0), (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
    g = 2 * (c1 * np.log(np.maximum(c1, 1e-9) / np.maximum(n1 * p, 1e-9)) + c0 * np.log(np.maximum(c0, 1e-9) / np.maximum(n0 * p, 1e-9)))
    good = np.flatnonzero((r1 > 2.5 * r0) & (c1 >= 1.9) & (g > 5))
    return good[np.argsort(-g[good], kind="stable")][:most]


def fit(rows, cols, vals, words, y, voters=96, features=1024, balance=0.1) -> Model:
    """y: 1, 0 or -1 (no label).  balance: share of label 1 of all that the sample stands for."""
    kinds, of = np.unique(cols, return_inverse=True)
    lexicon = _lexicon()
    known1, known0 = (y == 1).astype(float), (y == 0).astype(float)
    mined = kinds[_telling(of, len(kinds), rows, known1, known0, features)]
    model = Model(np.unique(np.r_[mined, lexicon]), np.zeros(0), 0.0, np.zeros(0, bool), (np.ones(1), 0.0))
    has = model.matrix(rows, cols, vals, len(y)) > 0
    # voters: stems that each add toxic documents to those before, then the lexicon, numbers and densities
    left, picked = known1.copy(), []
    gain = has.T.astype(np.float32)
    cost = gain @ known0
    for _ in range(voters):
        best = gain @ left - 2 * cost
        k = int(best.argmax())
        if best[k] < 2:
            break
        picked.append(k)
        left = left * np.where(has[:, k], 0.5, 1)
        cost[k] = np.inf
    abusive = np.isin(model.chosen, lexicon)
    voter = np.isin(np.arange(len(model.chosen)), picked) | (abusive & (gain @ known1 > gain @ known0))
    del gain
    counts = model.matrix(rows, cols, vals, len(y))
    kinds_of, hits, abuse = has[:, voter].sum(1), counts[:, voter].sum(1), counts[:, abusive].sum(1)
    density = hits / np.maximum(words, 1)
    patterns = [np.where(abuse > 0, 1, -1), np.where(abuse > 1, 1, -1), np.where(kinds_of > 1, 1, np.where(kinds_of == 0, 0, -1)), np.where(hits > 2, 1, -1), np.where(density > 0.01, 1, np.where((hits == 0) & (words >= 5), 0, -1)), np.where(has.any(1), -1, 0)]
    votes = np.c_[np.where(has[:, picked], 1, -1), np.stack(patterns, 1)].astype(np.int8)
    del has, counts
    share = (known1.sum() + balance * (y < 0).sum()) / len(y)  # the sample isn't drawn evenly
    q, _, _ = label_model(votes, float(np.clip(share, 1e-3, 0.9)))
    # features of the classifier: what tells the posterior labels
    new = np.unique(np.r_[model.chosen, kinds[_telling(of, len(kinds), rows, q, 1 - q, features)]])
    model = Model(new, np.zeros(0), 0.0, np.isin(new, model.chosen[voter]), (np.ones(1), 0.0))
    x = model.rows(model.matrix(rows, cols, vals, len(y)), words)
    r, c = np.nonzero(x)
    model.weight, model.bias = fit_logistic(r, c, x[r, c], q, x.shape[1], l2=3e-4, steps=1000, rate=0.2)
    z = np.clip(x @ model.weight + model.bias, -REACH, REACH)
    slope, shift = fit_dense(z[:, None], 0.98 * q + 0.01, l2=1e-4)
    shift += np.log(balance / (1 - balance)) - np.log(share / (1 - share))
    model.cal = (slope, shift) if slope[0] > 0 else (np.ones(1), 0.0)
    return model


def score(docs: DataFrame, model: Model | None, text="text", threshold=0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from ``threshold`` on).

    Every document gets a score; a null text counts as empty.  Without a model the score is 0.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        return docs.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    @F.arrow_udf("double")
    def rate(x: pa.Array) -> pa.Array:
        return pa.array(model.score(*as_text(x)))

    s = fresh(docs.columns, "_s")
    out = docs.withColumn(s, rate(F.lower(F.coalesce(F.col(text), F.lit("")))))
    return out.select(*names, F.col(s).alias("score"), F.when(F.col(s) >= threshold, 1).otherwise(0).alias("predicted"))


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; learned from rows that aren't held out."""
    held = F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")
