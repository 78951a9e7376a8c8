import json
import os

import pytest

from glossmill.plans import artifacts, config, pipeline
from glossmill.sources import files
from glossmill.streaming.divergence import diverged

BASE = {
    "seed": 1, "hf_model": "org/Base-1.5B", "output_dir": "models", "model_name": None, "dataset": {"type": "oscar", "language": "fr", "cache_dir": "data/${dataset.language}_docs"},
    "training": {"name": "quick_run", "max_steps": 1000, "save": "${divide:${training.max_steps},400}", "eval": "${divide:training.max_steps,400}", "max_length": 16, "dev_size": 0.1},
    "vocabulary": {"enabled": True, "vocab_size": 32768, "num_samples": 1500000, "use_seed_vocabulary": True, "seed_min_frequency": 2, "seed_filter_single_chars": False, "inherit_additional_special_tokens": False},
}


def resolved():
    c = json.loads(json.dumps(BASE))
    c["training"].pop("save")
    return config.resolve(c)


def test_resolution():
    c = resolved()
    assert c["training"]["eval"] == 2 and c["dataset"]["cache_dir"] == "data/fr_docs"
    with pytest.raises(ValueError, match="dataset.language"):
        config.resolve({"dataset": {"language": "???"}})


def test_names():
    c = resolved()
    assert artifacts.suffix(c) == "base15b_v32k_s1m_no-additional_seeded-min2-chars"
    assert artifacts.output_path(c) == f"models/fr/vocab_{artifacts.suffix(c)}_quick-run"
    assert artifacts.output_path(c | {"experiment_id": "x"}).endswith("quick-run_x") and artifacts.output_path(c | {"model_name": "n"}) == "models/n"
    assert artifacts.tokenized_path(c | {"vocabulary": {}}) == "data/fr_docs/tokenized"
    a, b = json.loads(json.dumps(c)), json.loads(json.dumps(c))
    b["vocabulary"]["num_samples"] = 1000001
    assert artifacts.suffix(a) == artifacts.suffix(b) and artifacts.identity(a) != artifacts.identity(b)


def test_differences(tmp_path):
    a, b = {"x": {"y": 1, "z": [1]}, "old": 1}, {"x": {"y": 2, "z": [1]}, "new": 1}
    assert config.diff(a, b) == ["new: only in the wished configuration", "old: only in the stored configuration", "x.y: 1 (stored) is now 2"]
    assert config.matches(None, b, "it") and config.matches(b, b, "it")
    with pytest.warns(UserWarning, match="x.y"):
        assert not config.matches(a, b, "it")
    config.save_config(a, str(tmp_path / "sub" / "c.yaml"))
    assert config.load_config(str(tmp_path / "sub" / "c.yaml")) == a and config.load_config(str(tmp_path / "none")) is None
    c = resolved()
    assert config.dataset_part(c) == {"type": "oscar", "seed": 1, "language": "fr"}
    assert config.tokenized_part(c)["tokenizer"]["train_dataset_cache"] == "data/fr_docs" and config.tokenizer_part({"vocabulary": {}}) is None


def test_memoised_and_cleaned(spark, tmp_path):
    path, calls = str(tmp_path / "a"), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert artifacts.stored(spark, path, {"k": 1}, make).count() == 3 and artifacts.stored(spark, path, {"k": 1}, make).count() == 3
    with pytest.warns(UserWarning):
        artifacts.stored(spark, path, {"k": 2}, make)
    assert len(calls) == 1
    os.remove(os.path.join(path, "data", "_SUCCESS"))
    artifacts.stored(spark, path, {"k": 1}, make)
    assert len(calls) == 2
    assert artifacts.clean(str(tmp_path), ["a", "none"]) == ["a"]
    with pytest.raises(ValueError):
        artifacts.clean(str(tmp_path), ["../x"])
    c = resolved()
    assert artifacts.stale(c) == [] and artifacts.stale(c, fresh_model=True) == [artifacts.output_path(c)]
    assert artifacts.stale(c, fresh_dataset=True, fresh_model=True)[0] == "data/fr_docs" and artifacts.tokenized_path(c) in artifacts.stale(c, fresh_tokenizer=True)


def test_from_configuration_to_ids(spark, tmp_path):
    import public_tokenizers

    spark.createDataFrame([(i, f"un deux {i}\ntrois", "fr" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    c = resolved()
    c["dataset"]["path"] = str(tmp_path / "docs")
    out = pipeline.prepare(spark, c, public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path))
    assert out.count() == 40 and {r[0] for r in out.select("split").distinct().collect()} == {"train", "test"} and pipeline.eval_splits(out) == ["test"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "ä b"), (1, "c"), (3, "d\ne")], "row_id long, text string")
    path = str(tmp_path / "x.jsonl")
    files.write_jsonl(df, path)
    assert [json.loads(x)["text"] for x in open(path, encoding="utf-8")] == ["c", "ä b", "d\ne"]
    files.write_text(files.read_jsonl(spark, path), files.text_path(path))
    assert files.text_path(path).endswith("x_spm.txt") and len(open(files.text_path(path), encoding="utf-8").readlines()) == 4
    seeds = spark.createDataFrame([("▁b", 3), ("▁a", 3), ('"q', 9)], "token string, freq long")
    files.write_seed_vocabulary(seeds, str(tmp_path / "v.tsv"))
    assert [x.rstrip("\n") for x in open(tmp_path / "v.tsv", encoding="utf-8")] == ['"q\t9', "▁a\t3", "▁b\t3"]
    assert sorted(files.read_seed_vocabulary(spark, str(tmp_path / "v.tsv")).collect()) == sorted(seeds.collect())


def test_run_logs(spark, tmp_path):
    for run in ("r1", "r2"):
        p = tmp_path / run / "checkpoint-9"
        p.mkdir(parents=True)
        more = '{"step": 9, "loss": NaN}' if run == "r1" else '{"step": 9, "eval_loss": 0.5}'
        (p / "state.json").write_text('{"log_history": [{"step": 1, "loss": 2.5}, ' + more + "]}")
    log = files.load_runs(spark, state_pattern=str(tmp_path / "*" / "checkpoint-9" / "state.json"))
    assert log.count() == 4 and {r[0] for r in log.select("run").distinct().collect()} == {"r1", "r2"} and "eval_loss" in log.columns
    (tmp_path / "raw.log").write_text("header\n{'loss': 1.5, 'step': 3}\n\n{'loss': nan, 'step': 4}\n".replace("nan", "NaN"))
    raw = files.load_runs(spark, log_file=str(tmp_path / "raw.log"), skip_lines=1)
    assert [(r.run, r.step) for r in raw.orderBy("step").collect()] == [("raw", 3), ("raw", 4)]
    with pytest.raises(ValueError):
        files.load_runs(spark)
    with pytest.raises(ValueError):
        files.load_runs(spark, log_pattern=str(tmp_path / "*.none"))


def test_streamed_divergence(spark, tmp_path):
    spark.createDataFrame([("a", 2, 0.0), ("a", 1, -1.0), ("b", 1, 1.0)], "run string, step int, loss double").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("run string, step int, loss double").parquet(str(tmp_path / "log"))
    q = diverged(stream).writeStream.outputMode("complete").format("memory").queryName("diverged").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("diverged").collect()] == [("a", 1)]


def test_command_line(spark, tmp_path, capsys):
    from glossmill.__main__ import main

    (tmp_path / "r").write_text("{'loss': 1.5, 'step': 3}\n{'loss': 1.0, 'step': 4}\n")
    main(["--log-file", str(tmp_path / "r"), "--list"])
    main(["--log-file", str(tmp_path / "r"), "lo*"])
    assert capsys.readouterr().out.split() == ["metric,n", "loss,2", "step,run,metric_name,metric_value", "3,r,loss,1.5", "4,r,loss,1.0"]
    with pytest.raises(SystemExit):
        main(["loss"])
