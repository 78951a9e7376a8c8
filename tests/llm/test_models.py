import numpy as np
import pyarrow as pa
import pytest
from .conftest import CLASHES, prose
from pyspark.sql import functions as F

from glossmill.llm import langid, quality, topk, toxicity
from glossmill.llm.common import as_text
from glossmill.llm.toxicity import label_model


def parse(text: bytes, trained: bytes) -> int:
    """Brute force: longest phrases that occur in the training text."""
    at, n = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in trained:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_against_brute_force():
    r = np.random.default_rng(2)
    make = lambda n, a: bytes(r.choice(list(a), n).astype(np.uint8))
    texts = (make(300, b"abc"), make(300, b"abd"))
    some = [make(k, b"abcdz").decode() for k in (0, 1, 5, 60, 200)]
    got = langid.phrases(*as_text(pa.array(some)), texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [parse(s.encode(), t) for s in some]


def test_languages_are_told_apart(spark):
    docs = spark.createDataFrame([(i, prose(i, 40, la), la) for i in range(300) for la in ("en", "fr")], "doc_id long, text string, lang string")
    out = langid.predict(docs, langid.learn(docs.where("doc_id < 100"))).where("doc_id >= 100")
    assert out.where("lang <> lang_pred").count() == 0 and out.where("score < 0 or score > 1").count() == 0


def test_languages_of_odd_tables(nasty, empty):
    trained = langid.learn(nasty)
    assert set(trained) == {"en", "fr"}
    rows = langid.predict(nasty, trained).collect()
    assert len(rows) == nasty.count() and all(r.lang_pred == "und" and r.score == 0 for r in rows if not r.text or not any(c.isalpha() for c in r.text))
    assert langid.learn(empty) == {} and langid.predict(empty, trained).count() == 0
    assert {r.lang_pred for r in langid.predict(nasty, {}).collect()} == {"und"}


def test_quality_on_documents_held_out(spark, nasty, empty):
    bad = lambda i: " | ".join(prose(i, 60).split()) if i % 2 else ("same " * 80)
    docs = spark.createDataFrame([(i, bad(i) if i % 4 == 0 else prose(i), "en", f"s{i % 3}") for i in range(800)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 800, 2)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    out = quality.score(docs, model).where("doc_id % 2 = 1 or doc_id % 4 = 0")
    assert out.where((F.col("doc_id") % 4 == 0).cast("int") == F.col("quality_pred")).count() == 0
    odd = quality.score(nasty, model)
    assert odd.count() == nasty.count() and odd.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
    assert quality.score(empty, model).count() == 0
    assert quality.learn(docs, labels.where("quality = 1")) is None and quality.learn(empty, labels) is None
    assert quality.score(nasty, None).where("quality_pred = 1").count() == nasty.count()


def test_toxicity_on_documents_held_out(spark, nasty, empty):
    slur = lambda i: " zorgl" + "aeiou"[i % 5] + " "
    docs = spark.createDataFrame([(i, prose(i, 60) + (slur(i) + "x" + slur(i + 1) if i % 5 == 0 else "")) for i in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 1500)], "doc_id long, toxic int")
    model = toxicity.learn(docs.where("doc_id < 1000"), labels.where("doc_id < 1000"))
    out = toxicity.score(docs, model).where("doc_id >= 1000")
    assert out.where((F.col("doc_id") % 5 == 0).cast("int") != F.col("predicted")).count() == 0
    odd = toxicity.score(nasty, model)
    assert odd.count() == nasty.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.learn(empty, labels) is None
    assert toxicity.score(nasty, None).where("predicted = 0").count() == nasty.count()


def test_scores_do_not_depend_on_how_a_long_text_is_cut(monkeypatch):
    from glossmill.llm import features

    text = pa.array([prose(5, 3000), "short", prose(6, 500)])
    before = quality.layout(*as_text(text))
    monkeypatch.setattr(quality, "chunks", lambda *a: features.chunks(*a, 2000))
    after = quality.layout(*as_text(text))
    assert (before[:, 0] == after[:, 0]).all() and (before[:, 5] == after[:, 5]).all()


def test_label_model_finds_the_better_voter():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    votes = np.stack([np.where(r.random(4000) < p, y, ~y) for p in (0.95, 0.9, 0.6)], 1).astype(int)
    votes = np.c_[votes, votes[:, 2], np.where(y & (r.random(4000) < 0.5), 1, -1)]  # a voter that repeats another, and one that mostly abstains
    votes[r.random(4000) < 0.2, 0] = -1
    q, odds, corr = label_model(votes, 0.3)
    assert ((q > 0.5) == y).mean() > 0.94 and odds[4] > odds[0] > odds[2] and corr[2, 3] > 0.9


def test_voters_overrule_labels():
    r = np.random.default_rng(4)
    texts = [f"{' '.join(r.choice(['stone', 'river', 'house', 'over'], 20))} {'zorgla zorgli' if k % 5 == 0 else ''}" for k in range(600)]
    who, what, words = toxicity.stems(*as_text(pa.array(texts)))
    y = np.array([int(k % 5 == 0) for k in range(600)])
    wrong = y.copy()
    wrong[[0, 5, 1, 2]] = [0, 0, 1, 1]  # labels that the voters contradict
    for labels in (y, wrong):
        model = toxicity.fit(who, what, np.ones(len(who)), words.astype(float), labels, balance=0.2)
        assert ((model.score(*as_text(pa.array(texts))) >= 0.7) == y).all()


def test_many_languages_and_scripts(spark):
    make = lambda i, la: " ".join("".join(chr(0x400 + la * 90 + np.random.default_rng(i * 77 + k).integers(0, 30)) for _ in range(5)) for k in range(12))
    docs = spark.createDataFrame([(i, make(i * 31 + la, la), f"l{la:02}") for i in range(24) for la in range(10)], "doc_id long, text string, lang string")
    trained = langid.learn(docs.where("doc_id < 16"))
    assert len(trained) == 10 and all(len(x) <= 24576 for x in trained.values())
    out = langid.predict(docs, trained).where("doc_id >= 16")
    assert out.where("lang <> lang_pred").count() <= 2


def test_winner_against_brute_force(spark):
    trained = {"a": b"the stone over the river of that house", "b": b"le que dans eau pour le que", "c": b"the stone over the"}
    texts = ["over the stone", "que dans", "zzz", "the house of le que", "Stone RIVER"]
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trained).collect()
    for r in rows:
        t = r.text.lower().encode()
        cost = {k: parse(t, v) * np.log2(len(v)) for k, v in trained.items()}
        assert r.lang_pred == min(sorted(cost), key=lambda k: cost[k])


def test_cotraining_on_labels_held_out(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels.where("doc_id % 3 <> 0"))
    want = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] % 3 == 0}
    got = {r.doc_id: r.quality_pred for r in quality.score(docs, model).select("doc_id", "quality_pred").collect()}
    right = [got[k] == v for k, v in want.items()]
    assert len(right) > 100 and np.mean(right) > 0.95


def brute(ids, x, queries, k):
    out = {}
    for q, v in queries:
        s = sorted(((-int(v @ b), i) for i, b in zip(ids, x, strict=True) if i != q))[:k]
        out[q] = [(i, -a) for a, i in s]
    return out


@pytest.mark.parametrize("block", [64, 1000])
def test_top_k_against_brute_force(spark, block):
    r = np.random.default_rng(3)
    x = r.integers(-9, 9, (500, 8))
    x[100:200] = x[7]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<int>").repartition(3)
    got = {}
    for r_ in topk.top_k(df, df.where("vec_id % 20 = 0"), 12, block=block, query_block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r_.query_id, []).append((r_.vec_id, r_.score))
    assert got == brute(range(500), x, [(i, x[i]) for i in range(0, 500, 20)], 12)


def test_top_k_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.26]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (20, [inf, 0.0]), (None, [1.0, 1.0]), (5, [1.0, 0.0]), (6, [-1.0, 0.0]), (40, [0.0, 0.0])]
    df = topk.quantise(spark.createDataFrame(rows, "vec_id long, v array<float>"), "v", "x")
    out = topk.top_k(df, df.where("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(out)] == [(0, 1, 5, 2048), (0, 2, 40, 0), (0, 3, 6, -2048), (40, 1, 0, 0), (40, 2, 5, 0), (40, 3, 6, 0)]
    assert topk.top_k(df.where("vec_id = 1"), df).count() == 0
    # shorter vectors count as if zeros followed; empty ones score 0; of equal ids the least vector asks
    some = spark.createDataFrame([(20, [1]), (2, [3, 2]), (3, []), (20, [0, 5])], "vec_id long, x array<int>")
    out = topk.top_k(some, some.where("vec_id = 20")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(out)] == [(20, 1, 2, 10), (20, 2, 3, 0)]
    none = spark.createDataFrame([(20, []), (2, [])], "vec_id long, x array<int>")
    assert [tuple(r) for r in topk.top_k(none, none.where("vec_id = 20")).collect()] == [(20, 1, 2, 0)]


def test_top_k_of_any_finite_components(spark):
    r = np.random.default_rng(5)
    scale = [1.0] * 60 + [3e7, 1e8, 1e12, 5e15, 1e30, 3e38]
    rows = [(i, [float(np.float32(v)) for v in r.normal(size=4) * s]) for i, s in enumerate(scale)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    x = topk.quantise(df, "v", "x")
    out = topk.top_k(x, x.where("vec_id % 3 = 0"), 7, block=16, query_block=4).collect()
    whole = {i: [int(np.floor(64 * c)) if abs(c) < 1e15 else 64 * int(c) for c in v] for i, v in rows}
    got = {}
    for y in sorted(out):
        got.setdefault(y.query_id, []).append((y.vec_id, y.score))
    for q in range(0, len(rows), 3):
        s = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:7]
        clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
        assert got[q] == [(i, clip(-a)) for a, i in s]


def test_clashing_columns_stay(nasty):
    assert set(CLASHES) <= set(toxicity.score(nasty, None).columns) | {"score", "predicted"}
