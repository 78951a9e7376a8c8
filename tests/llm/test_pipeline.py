import pytest

import corpus_pipeline
from glossmill.llm.common import write_shared


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (13, 0, 0), (9, 0, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("which", ["nasty", "empty"])
def test_every_stage_takes_odd_tables(spark, labels_dir, which, request):
    docs = request.getfixturevalue(which)
    before = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, labels_dir)
        if k < 4:
            assert out.columns == before
            docs = write_shared(out, "test")
    assert out.columns[:2] == ["doc_id", "piece"]


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
