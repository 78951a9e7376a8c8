import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glossmill.llm import packing
from glossmill.llm.common import as_text
from glossmill.llm.tokens import encoder


@pytest.fixture(scope="module")
def code():
    return encoder(packing.tokenizer_path())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.mark.parametrize("alphabet", ["ab '\n\tsetrvldm.12é’ ,ABZ\r", "a  \n  　é中🙂'x1½\x1c͸"])
def test_ids_are_those_of_the_tokenizer(code, public, alphabet):
    r = random.Random(1)
    texts = ["", None, "<|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|> b\n<|endoftext|", "<|endoftext", *["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(800)]]
    ids, n = code.encode(*as_text(pa.array(texts)), 2)
    at = np.cumsum(n)
    for t, b, k in zip(texts, at, n, strict=True):
        assert ids[b - k : b].tolist() == [*public.encode(t or "", add_special_tokens=False).ids, 2]


def test_a_task_holds_little_beside_its_texts(spark):
    r = np.random.default_rng(5)
    texts = pa.array([" ".join(x) for x in r.choice([f"w{k}" for k in range(1000)], (2000, 800))])  # 8 MB
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], ["doc_id", "text"])

    class Docs:
        schema = spark.range(0).withColumnRenamed("id", "doc_id").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    cut = packing.pieces(Docs(), packing.tokenizer_path())
    assert sum(b.num_rows for b in cut(iter([batch]))) >= 2000  # what the encoder remembers is there
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for _ in cut(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert most < 35e6


def test_a_very_long_text_is_cut_where_no_token_is(code, public):
    r = random.Random(2)
    text = " ".join("".join(r.choice("abc'sé,1") for _ in range(r.randint(1, 9))) for _ in range(500_000))
    ids, _ = code.encode(*as_text(pa.array([text])))
    assert ids.tolist() == public.encode(text, add_special_tokens=False).ids


def fewest(sizes, capacity):
    """Brute force."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def test_bounds_and_best_fit_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(60):
        sizes = np.sort(r.integers(1, 21, r.integers(1, 9)))[::-1].copy()
        where, offset = packing.best_fit(sizes, 20)
        spans = sorted(zip(where.tolist(), offset.tolist(), sizes.tolist(), strict=True))
        for k, own in itertools.groupby(spans, lambda s: s[0]):
            own = list(own)
            assert own[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in itertools.pairwise(own)) and own[-1][1] + own[-1][2] <= 20
        exact = fewest(sizes.tolist(), 20)
        assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= exact <= where.max() + 1


def check(rows, documents):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(own)) and sum(own[-1]) <= 1024
    assert sum(r.piece == 0 for r in rows) == documents
    return by


def test_pack_documents(spark, nasty, empty, public):
    cut = packing.pieces(nasty, packing.tokenizer_path(), keep_ids=True)
    rows = packing.pack(cut).collect()
    check(rows, nasty.count())
    texts = {r.doc_id: r.text or "" for r in nasty.collect()}
    for r in rows:
        if r.doc_id is not None:
            want = [*public.encode(texts[r.doc_id], add_special_tokens=False).ids, 2][r.start : r.start + r.length]
            assert r.ids == want and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
            assert r.length == 1024 or r.piece == 0
    assert packing.pack(packing.pieces(empty, packing.tokenizer_path())).count() == 0


def test_partitions_with_gaps_exchange_pieces(spark):
    r = random.Random(4)
    items = spark.createDataFrame([(i, r.choice([342, 341, 700, 512, 513, 100]), i) for i in range(4000)], "doc_id long, length long, salt long").repartition(3)
    few = packing.pack(items, task_rows=200)
    assert few.count() == 4000
    lengths = np.array([x.length for x in items.collect()])
    assert few.select("sequence_id").distinct().count() <= packing.best_fit(lengths)[0].max() + 1 + 20
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000, 1)], "doc_id long, length long, salt long"))


def test_exchange_stops_and_groups_stay_bounded(spark):
    r = random.Random(5)
    items = spark.createDataFrame([(i, r.randint(200, 400), i, "x") for i in range(6000)], "doc_id long, length long, salt long, offset string")
    out = packing.pack(items, task_rows=500)
    assert out.columns == ["doc_id", "length", "salt", "offset", "sequence_id", "_offset"]
    rows = out.collect()
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x["_offset"], x.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(own)) and sum(own[-1]) <= 1024
    assert sorted(x.doc_id for x in rows) == list(range(6000))
    whole = packing.best_fit(np.array([x.length for x in rows]))[0].max() + 1
    assert len(by) <= 1.02 * whole
