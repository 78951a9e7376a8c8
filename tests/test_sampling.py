import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.operators import sampling
from glossmill.sources import corpus


def pool(spark, sizes):
    return spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "source string, row_id long")


def test_positions_equal_row_number(spark):
    df = pool(spark, {"a": 300, "b": 50}).withColumn("k", F.md5(F.concat("source", F.col("row_id").cast("string"))))
    from pyspark.sql.window import Window

    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("k", "row_id")).cast("long"))
    got = sampling.positions(df, ["source"], "k", ["row_id"]).select(want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=8).filter(any), st.floats(0.05, 1.5), st.integers(1, 5000))
@settings(max_examples=200, deadline=None)
def test_allocation_adds_up(sizes, alpha, total):
    k = sampling.allocate(sizes, alpha, total)
    assert sum(k) == total and all(abs(a - p * total) <= 1 + len(sizes) for a, p in zip(k, sampling.probabilities(sizes, alpha), strict=True))


def test_known_allocations():
    sizes = [116, 558, 95, 130]
    assert sampling.allocate(sizes, 0.3, 1000) == [219, 350, 205, 226]
    assert sampling.allocate(sizes, 0.7, 1000) == [168, 505, 146, 181]
    assert sampling.allocate(sizes, 1.0, 1000) == [130, 621, 105, 144]


def test_mixture_invariants(spark):
    df = pool(spark, {"a": 200, "b": 30, "c": 60})
    train, dev, report = sampling.multinomial(df, 0.5, 400, 0.1)
    rows, held = train.collect(), {(r.source, r.row_id) for r in dev.collect()}
    assert len(rows) == 400 and not held & {(r.source, r.row_id) for r in rows} and len(held) == 20 + 3 + 6
    for name, n_dev, n, k, percent in report:
        own = [r.row_id for r in rows if r.source == name]
        assert len(own) == k and percent == 100 * k / 400
        assert len(set(own)) == k if k <= n else len(set(own)) <= n
    again = sampling.multinomial(df.repartition(7), 0.5, 400, 0.1)[0]
    assert sorted(again.collect()) == sorted(rows)


def test_alpha_moves_shares():
    assert sampling.probabilities([100, 300], 1.0) == [0.25, 0.75]
    assert abs(sampling.probabilities([100, 300], 1e-9)[0] - 0.5) < 1e-6
    assert sampling.probabilities([100, 300], 0.5)[0] > 0.25


def test_errors(spark):
    df = pool(spark, {"a": 20, "b": 20})
    for args in ((0.5, 0, 0.1), (0, 10, 0.1), (0.5, 10, None), (0.5, 10, 1.0)):
        with pytest.raises(ValueError):
            sampling.multinomial(df, *args)
    with pytest.raises(ValueError, match="empty"):
        sampling.draw(df.withColumn("pool_idx", F.col("row_id")), [("gone", 0, 1)])
    with pytest.raises(ValueError):
        sampling.allocate([0, 0], 1.0, 5)
    with pytest.raises(ValueError):
        sampling.dev_rows(10, 0)
    assert sampling.dev_rows(129, 0.1) == 13 and sampling.dev_rows(100, 1.0) == 1


def test_subset_is_exact_and_clamped(spark):
    df = pool(spark, {"a": 100}).drop("source")
    assert sampling.subset(df, 17).count() == 17 and sampling.subset(df, 1000).count() == 100


def test_nested_sources(spark, tmp_path):
    for i, text in enumerate(("Line 1\n\n\nLine 2\n   \nLine 3", "x\ny")):
        (tmp_path / f"{i}.txt").write_text(text, encoding="utf-8")
    one = {"type": "plaintext", "path": str(tmp_path / "0.txt")}
    both = corpus.load(spark, {"type": "concat", "sources": [one, {"type": "plaintext", "path": str(tmp_path / "1.txt")}]})
    assert [r.text for r in both.orderBy("source_idx", "row_idx").collect()] == ["Line 1", "Line 2", "Line 3", "x", "y"]
    with pytest.raises(ValueError, match="empty"):
        corpus.load(spark, {"type": "concat", "sources": []})
    with pytest.raises(ValueError, match="Unsupported"):
        corpus.load(spark, {"type": "sql"})
    with pytest.raises(ValueError, match="dev_size"):
        corpus.load(spark, {"type": "concat", "sources": [{"type": "multinomial", "sources": [one], "alpha": 1, "total_samples": 1}]})
    big = {"type": "plaintext_dir", "directory": str(tmp_path)}
    mixed = corpus.load(spark, {"type": "multinomial", "sources": [big | {"language": "x"}, big | {"language": "y"}], "alpha": 0.7, "total_samples": 9}, 0.2)
    assert mixed.where("split = 'train'").count() == 9 and {r[0] for r in mixed.select("split").distinct().collect()} == {"train", "x", "y"}
    with pytest.raises(ValueError):
        corpus.mixture([both, both], ["x", "x"], 1, 1, 0.1)
    with pytest.raises(ValueError):
        corpus.mixture([both, both], ["x", "train"], 1, 1, 0.1)


def test_plaintext_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="not found"):
        corpus.read_plaintext(spark, str(tmp_path / "none.txt"))
    (tmp_path / "blank.txt").write_text("\n\n   \n\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no non-empty lines"):
        corpus.read_plaintext(spark, str(tmp_path / "blank.txt"))
    with pytest.raises(FileNotFoundError):
        corpus.read_plaintext_dir(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        corpus.read_plaintext_dir(spark, str(tmp_path / "blank.txt"))
    with pytest.raises(ValueError):
        corpus.read_plaintext_dir(spark, str(tmp_path), "*.md")
    (tmp_path / "bad.txt").write_bytes(b"ok\nb\xffd\r\nlast")
    with pytest.raises(Exception, match="(?i)utf"):
        corpus.read_plaintext(spark, str(tmp_path / "bad.txt")).collect()
    assert corpus.read_plaintext(spark, str(tmp_path / "bad.txt"), strict=False).count() == 3
    assert corpus.read_plaintext_lines(spark, str(tmp_path / "bad.txt")).count() == 3
