import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill import queries
from glossmill.functions import text as fn
from glossmill.operators import embed, metrics, monitor, runlog, tokenize, vocab


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_strip_is_pythons(spark):
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [f"{w}a{w}b{w}" for w in white] + ["".join(white), "", "​x​"]
    out = column(spark, values).select("i", fn.strip(F.col("v")).alias("s")).orderBy("i").collect()
    assert len(white) == 29 and [r.s for r in out] == [v.strip() for v in values]


def test_lines(spark):
    values = ["a\n", "", "\na\n\nb", "a\r\nb"]
    rows = fn.docs_to_lines(column(spark, values).withColumnRenamed("v", "text")).orderBy("i", "pos").collect()
    assert [r.line for r in rows] == [x for v in values for x in v.split("\n")]


def test_numbers_and_names(spark):
    want = {50000: "50k", 1000: "1k", 1500: "1k", 1000000: "1m", 5000000: "5m", 1500000: "1m", 999: "999", 100: "100", 1: "1", 0: "0"}
    out = column(spark, list(want), "long").select("v", fn.format_number(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in out} == want
    names = {"org/Some-Model.1B": "somemodel1b", "plain": "plain"}
    out = column(spark, list(names)).select("v", fn.model_shortname(F.col("v")).alias("s"), fn.capitalize(F.col("v")).alias("c")).collect()
    assert {r.v: r.s for r in out} == names and all(r.c == r.v.capitalize() for r in out)


def test_argmax(spark):
    logits = [[[0.0, 3.0, 3.0], [5.0, 1.0, 2.0]]]
    assert column(spark, logits, "array<array<float>>").select(metrics.argmax_rows(F.col("v")).alias("a")).first().a == [1, 0]


def distinct(spark, pred, label=None, **kw):
    df = spark.createDataFrame([(p, label[i] if label else None) for i, p in enumerate(pred)], "pred array<int>, label array<int>")
    r = metrics.distinctness(df, label="label" if label else None, **kw).first()
    return r.distinct_1_batch, r.distinct_1_seq, r.num_eval_tokens


def test_distinctness(spark):
    unique = [list(range(10 * i, 10 * i + 10)) for i in range(4)]
    assert distinct(spark, unique, [[1] * 10] * 4) == (1.0, 1.0, 40)
    assert distinct(spark, [[42] * 10] * 4) == (1 / 40, pytest.approx(0.1), 40)
    assert distinct(spark, [[2 * i, 2 * i + 1] * 4 for i in range(4)]) == (8 / 32, 0.25, 32)
    labels = [[1] * 8 + [-100] * 2, [1] * 6 + [-100] * 4]
    assert distinct(spark, unique[:2], labels) == (1.0, 1.0, 14)
    assert distinct(spark, [[10, 10, 20, 20, 30], [40, 40, 40, 50, 50]]) == (0.5, 0.5, 10)
    assert distinct(spark, [[1, 2]], [[-100, -100]]) == (0.0, 0.0, 0)
    with pytest.raises(ValueError):
        metrics.distinctness(spark.createDataFrame([([[1.0]],)], "pred array<array<float>>"), label=None)


def test_vocabulary_checks(spark):
    make = lambda ids: spark.createDataFrame([(f"token_{i}", i) for i in ids], "token string, id int")
    vocab.validate(make(range(10)), 10)
    with pytest.raises(ValueError, match="range"):
        vocab.validate(make(range(1, 11)), 10)
    with pytest.raises(ValueError, match="expected"):
        vocab.validate(make(range(10)), 12)
    with pytest.raises(ValueError, match="contiguous"):
        vocab.validate(make([0, 1, 1, 3]), 4)


def test_reasons_in_order(spark):
    counts = spark.createDataFrame([("<s>", 1), ("<s>x", 5), ("<mask>", 5), ("<madeupword3>", 5), ("▁reg", 5), ("▁a", 5), ("▁", 5), ("▁ok", 5)], "token string, freq long")
    r = vocab.rejection(F.col("token"), F.col("freq"), min_frequency=2, single=True, registered=("▁reg",))
    got = {x.token: x.r for x in counts.select("token", r.alias("r")).collect()}
    assert got == {"<s>": "below_min_frequency", "<s>x": None, "<mask>": "special_token", "<madeupword3>": "madeupword_token", "▁reg": "registered_special", "▁a": "single_char", "▁": None, "▁ok": None}


def test_special_tokens_and_algorithms():
    assert vocab.special_tokens() == {"unk_piece": "<unk>", "unk_id": 0, "bos_piece": "<s>", "bos_id": 1, "eos_piece": "</s>", "eos_id": 2, "pad_piece": "<pad>", "pad_id": -1}
    got = vocab.special_tokens({"pad_token_id": 0, "additional_special_tokens": ["<x>", "<y>"]})
    assert got["pad_id"] == 0 and got["user_defined_symbols"] == "<x>,<y>" and "user_defined_symbols" not in vocab.special_tokens({"additional_special_tokens": ["<x>"]}, False)
    assert vocab.algorithm("UnigramModel") == "unigram" and vocab.algorithm("BPE") == "bpe"
    with pytest.raises(ValueError):
        vocab.algorithm("WordPiece")


def test_tokenize_and_collate(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, "a b " * i) for i in range(20)], "row_id long, text string")
    out = tokenize.tokenize(df, path, 8, 0.2)
    assert out.where("size(input_ids) > 8 or size(input_ids) <> size(attention_mask)").count() == 0
    assert {r[0]: r[1] for r in out.groupBy("split").count().collect()} == {"test": 4, "train": 16}
    b = tokenize.collate(out.withColumn("batch", F.lit(0)), "batch", 1)
    assert b.where("size(input_ids) <> 8 or size(labels) <> 8").count() == 0
    words = spark.createDataFrame(tokenize.vocabulary_of(path), "token string, id int")
    vocab.validate(words, 32000)


def test_patterns():
    names = ["loss", "eval_loss", "eval_x", "lr"]
    assert runlog.expand(["lr", "eval_*", "none", "*loss"], names) == ["lr", "eval_loss", "eval_x", "none", "loss"]


def test_series(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", None, 0.1, 1.0), ("a", None, 0.2, nan), ("b", None, 0.3, None)], "run string, step long, epoch double, loss double")
    assert runlog.series(df, "loss").columns == ["epoch", "loss", "run"] and runlog.series(df, "loss").count() == 1
    assert runlog.series(df.where("run = 'b'"), "loss") is None
    with pytest.raises(ValueError, match="loss"):
        runlog.series(df, "gone")
    assert [tuple(r) for r in runlog.metric_counts(df).collect()] == [("loss", 1)]
    with pytest.raises(ValueError):
        runlog.melt(df, ["gone"])
    with pytest.raises(ValueError):
        runlog.union([])


@pytest.mark.parametrize("patience,delay", [(1, 0.0), (2, 0.3), (3, 0.5), (5, 0.0)])
def test_early_stopping_against_a_loop(spark, patience, delay):
    r = random.Random(patience)
    rows = [(run, step, r.randint(0, 30) / 10) for run in range(4) for step in range(0, 400, 10)]
    want = {}
    for run in range(4):
        best, bad = None, 0
        for _, step, loss in (x for x in rows if x[0] == run):
            up = best is None or loss < best
            best = loss if up else best
            if step < int(delay * 400):
                continue
            bad = 0 if up else bad + 1
            if bad >= patience:
                want[run] = step
                break
    got = monitor.early_stop(spark.createDataFrame(rows, "run int, step int, eval_loss double"), patience, delay, 400)
    assert {x.run: x.stop_step for x in got.collect()} == want


def test_divergence(spark):
    log = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.0), ("b", 1, 1.0)], "run string, step int, loss double")
    with pytest.raises(RuntimeError, match="step 2"):
        monitor.check_divergence(log)
    monitor.check_divergence(log.where("run = 'b'"))


def test_sparsemax_and_initial_embeddings(spark):
    scores = spark.createDataFrame([(0, k, z) for k, z in enumerate([0.9, 0.8, 0.1, -1.0])], "id int, key int, z double")
    got = {r.key: round(r.weight, 9) for r in embed.sparsemax(scores).collect()}
    assert got == {0: 0.55, 1: 0.45}
    old = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, embedding array<double>")
    new = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "token string, id int")
    aux = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "token string, aux array<double>")
    out = {r.token: r.embedding for r in embed.initialise(old, new, aux).collect()}
    assert out == {"a": [1.0, 0.0], "b": [0.0, 2.0], "c": [1.0, 0.0], "d": [0.5, 1.0]}


def test_auxiliary_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "c", "rare"] if i == 0 else ["a", "b", "c"],) for i in range(10)], "tokens array<string>")
    got = {r.token: r.aux for r in embed.auxiliary(df, dim=8).collect()}
    assert set(got) == {"a", "b", "c"} and all(len(v) == 8 for v in got.values())


def test_counts_of_a_public_vocabulary(spark, tmp_path):
    import public_tokenizers
    import sentencepiece
    from collections import Counter

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["  the house  ", "", None, " \u2003 ", "the river and the house", "été"]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter(i for t in texts if t and t.strip() for i in model.encode(t.strip()))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = vocab.tokenizer_counts(df, path).collect()
    assert {r.id: r.freq for r in got} == want and all(model.id_to_piece(r.id) == r.token for r in got)
    out = str(tmp_path / "seed.tsv")
    assert vocab.extract_seed_vocabulary(df, path, out, min_frequency=2) and not vocab.extract_seed_vocabulary(df, path, out)
    with open(out, encoding="utf-8") as f:
        assert [x.rstrip("\n").split("\t") for x in f] == [[model.id_to_piece(i), str(n)] for i, n in sorted(want.items(), key=lambda x: (-x[1], model.id_to_piece(x[0]))) if n > 1]


def test_lines_of_documents_are_in_numeric_order(spark, tmp_path):
    from glossmill.sources import corpus

    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, "\n".join(f"{i}-{k}" for k in range(12)), "en") for i in (9, 10, 100, 1)], "doc_id long, text string, lang string").write.parquet(path)
    docs = corpus.read_documents(spark, path, "en")
    want = [f"{i}-{k}" for i in (1, 9, 10, 100) for k in range(12)]
    assert [r.text for r in docs.orderBy("row_idx").collect()] == want
    other = docs.select("split", "source_idx", "source_name", F.monotonically_increasing_id().alias("row_idx"), "text").where("text = '1-0'")
    both = corpus.concat([docs, other])
    assert [r.text for r in both.orderBy("source_idx", "row_idx").collect()] == [*want, "1-0"]


def test_a_log_line_of_another_kind_is_an_error(spark, tmp_path):
    from glossmill.sources import files

    path = str(tmp_path / "a.log")
    with open(path, "w") as f:
        f.write("{'loss': 1.5, 'step': 1}\nTraining ended\n")
    with pytest.raises(Exception, match="not a log line"):
        files.read_raw_log(spark, path).collect()


def _random_vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    return spark.createDataFrame([(i, v) for i, v in enumerate([*rng.normal(size=(n, 6)).tolist(), *odd])], f"{name} int, aux array<double>")


def test_similarity_works_on_matrices(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 16)
    monkeypatch.setattr(embed, "CELLS", 100)
    q, k = _random_vectors(spark, 50, 1, "id"), _random_vectors(spark, 90, 2, "key")
    out = embed.similarity(q, k)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    want = q.select("id", embed.unit(F.col("aux")).alias("_q")).crossJoin(k.select("key", embed.unit(F.col("aux")).alias("_k"))).select("id", "key", embed.dot(F.col("_q"), F.col("_k")).alias("z"))
    plain = lambda df: {(r.id, r.key): None if r.z is None else round(r.z, 9) for r in df.collect()}
    assert plain(out) == plain(want) and out.count() == 55 * 95


def test_contenders_are_few_and_have_all_weights(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 64)
    monkeypatch.setattr(embed, "TOP", 8)
    q, k = _random_vectors(spark, 40, 3, "id"), _random_vectors(spark, 600, 4, "key")
    q = q.unionByName(spark.createDataFrame([(99, [float("nan")] * 6)], q.schema))
    some = embed.contenders(q.where("id <> 42"), k)  # query 42 is zero: all keys contend
    weights = lambda z: {(r.id, r.key): round(r.weight, 9) for r in embed.sparsemax(z).collect() if r.weight > 1e-9}
    want = weights(embed.similarity(q.where("id <> 42"), k))
    assert weights(some) == want and {i for i, _ in want} >= set(range(40)) and some.where("not isnan(z)").count() < 40 * 605 / 4
    assert weights(embed.contenders(q.where("id = 42"), k)) == weights(embed.similarity(q.where("id = 42"), k))


def test_sparsemax_of_initial_embeddings_gets_contenders_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(embed, "similarity", lambda *a, **k: asked.append(a) or 1 / 0)
    old = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, embedding array<double>")
    new = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, id int")
    aux = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "token string, aux array<double>")
    assert {r.token: r.embedding for r in embed.initialise(old, new, aux).collect()}["c"] == [1.0, 0.0] and not asked


@pytest.mark.parametrize("name", ["embed_sparsemax", "embed_combine"])
def test_queries_of_weights_get_contenders_only(spark, monkeypatch, name):
    asked, whole = [], embed.contenders
    monkeypatch.setattr(embed, "contenders", lambda *a: asked.append(a) or whole(*a))
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1 and asked


def test_texts_are_encoded_in_small_pieces(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenize, "PIECE", 1000)
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", *(f"some words of text {i} " * (i % 9) for i in range(200)), "long " * 900, None]
    sizes = []

    def watched(x):
        sizes.append(sum(map(len, x)))
        assert len(x) == 1 or sizes[-1] <= 1000
        return tokenize.load(path)(x)

    want = iter(tokenize.load(path)([t for t in texts if t is not None]))
    want = [None if t is None else next(want) for t in texts]
    ids = tokenize.encode(F.col("v"), path)
    few = tokenize.encode(F.col("v"), path, 5)
    assert [r.x for r in column(spark, texts).orderBy("i").select(few.alias("x")).collect()] == [t and t[:5] for t in want]
    assert [r.x for r in column(spark, texts).orderBy("i").select(ids.alias("x")).collect()] == want
    parts = list(tokenize.pieces(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 10
    assert all(watched([t for t in p.to_pylist() if t is not None]) is not None for p in parts) and max(sizes) == 4500
    assert list(tokenize.pieces(pa.array([], pa.string()))) == []


def test_ids_are_counted_where_they_are_made(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", "  ", *(f"some words of text {i} " * (i % 9) for i in range(60))]
    out = vocab.tokenizer_counts(column(spark, texts).withColumnRenamed("v", "text"), path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "Generate" not in plan
    ids = [x for t in tokenize.load(path)([t.strip() for t in texts if t and t.strip()]) for x in t]
    assert {r.id: r.freq for r in out.collect()} == {x: ids.count(x) for x in ids}
    assert vocab.tokenizer_counts(column(spark, [None, ""]).withColumnRenamed("v", "text"), path).count() == 0
