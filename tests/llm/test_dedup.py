import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.llm import linededup, neardup
from glossmill.llm.common import as_text

from .conftest import prose


def boiler(i):
    return f"Posted by user{i} on day {i % 31} under the usual terms of this site in town{i % 7} today"


def test_templates_with_variable_fields_are_dropped(spark):
    docs = spark.createDataFrame([(i, prose(i) + "\n" + boiler(i) + "\n" + prose(i + 1000, 24)) for i in range(40)], "doc_id long, text string")
    out = linededup.dedup_lines(docs).collect()
    for r in out:
        assert r.text == prose(r.doc_id) + "\n" + prose(r.doc_id + 1000, 24) and r.n_dropped == 1


def test_copies_are_not_boilerplate(spark):
    text = prose(1)
    near = [text.replace(" ", f" w{i} ", 1) for i in range(30)]
    rows = [*enumerate([text] * 50 + near), *((100 + i, prose(i)) for i in range(2, 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linededup.dedup_lines(docs).where("n_dropped > 0").count() == 0


def test_a_passage_of_many_words_goes_from_all_documents(spark):
    passage = " ".join(prose(777, 60).split())
    docs = spark.createDataFrame([(i, prose(i, 240) + "\n" + passage) for i in range(15)] + [(i, prose(i)) for i in range(20, 30)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert not any(passage in t for t in out.values()) and all(out[i] == prose(i) for i in range(20, 30))


def test_a_long_passage_in_two_unrelated_texts_goes_and_stays_in_copies(spark):
    passage = lambda k: " ".join(prose(7000 + k, 60).split())
    rows = {i: prose(i, 240) + "\n" + passage(i // 2) + "\n" + prose(100 + i, 120) for i in range(8)}
    short = {20 + i: prose(200 + i, 12) + "\n" + passage(77) for i in range(30)}  # the passage is most of each
    base = [*prose(300, 240).split("\n"), passage(88), *prose(301, 240).split("\n")]
    copies = {60 + i: "\n".join(edited(x, 40 * i + k, 0.05) if len(x.split()) < 50 else x for k, x in enumerate(base)) for i in range(2)}
    docs = spark.createDataFrame(list((rows | short | copies).items()), "doc_id long, text string")
    out = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert all(passage(i // 2) not in out[i] and out[i] == rows[i].replace(passage(i // 2) + "\n", "") for i in rows)
    assert all(out[i] == short[i].split("\n")[0] for i in short) and all(out[i] == copies[i] for i in copies)


def test_short_lines_and_scripts_without_spaces(spark):
    wide = "".join(chr(0x4E00 + 7 * k % 3000) for k in range(160))
    rows = [(i, prose(i, 60) + "\nSubscribe now\n" + prose(500 + i, 36) + ("\n" + wide if i < 2 else "") + "\n\n") for i in range(40)]
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Subscribe" not in out[i].text and wide not in out[i].text and out[i].text.endswith("\n\n") for i, _ in rows)


def test_lines_of_odd_tables(nasty, empty):
    rows = linededup.dedup_lines(nasty, min_docs=2).collect()
    assert len(rows) == nasty.count() and all(r.text is None for r in rows if r.n_lines == 0)
    assert linededup.dedup_lines(empty).count() == 0


def sets(texts):
    e, n = neardup.shingles(*as_text(pa.array(texts)))
    at = np.cumsum(n)
    return [set(e[b - k : b].tolist()) for b, k in zip(at, n, strict=True)]


def test_large_lookups_are_not_broadcast(spark, tmp_path):
    # 600,000 numbers make files of less than Spark's threshold, but many salted rows
    spark.range(600_000).select((F.col("id") * 2).alias("k")).write.parquet(f"{tmp_path}/right")
    left = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("pos"))
    got = linededup._lookup(left, spark.read.parquet(f"{tmp_path}/right"), "k", ["pos"])
    assert got.count() == 500
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_shingles_against_brute_force():
    for t, s in zip(texts := [prose(3, 50), "", None, "one two", "a b c a b c", "x"], sets(texts), strict=True):
        w = (t or "").split()
        assert len(s) == (len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0)


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"q{r.randint(0, 10**6)}" if r.random() < share else w for w in text.split())


def test_links_and_groups_against_brute_force(spark):
    texts = {}
    for k in range(60):
        base = prose(k, 150)
        for j in range(k % 6 + 1):
            texts[len(texts)] = edited(base, j, 0.02 * j) if j else base
    copies = {1000 + i: texts[i] for i in range(0, 40, 3)}
    docs = spark.createDataFrame(list((texts | copies).items()), "doc_id long, text string")
    found, links = neardup.near_duplicates(docs, recall=0.999)
    got = {(r.a, r.b) for r in links.collect()}
    s = sets([t.lower() for t in texts.values()])
    want = {(a, b) for a, b in combinations(range(len(s)), 2) if len(s[a] & s[b]) >= 0.7 * min(len(s[a]), len(s[b]))}
    assert got <= want and len(want - got) <= 0.01 * len(want) + 1
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == set(texts) | set(copies) and all(rows[i].text_id == i - 1000 and rows[i].class_id == rows[i - 1000].class_id for i in copies)
    kept = neardup.keep_one(docs).collect()
    assert len(kept) == len({r.class_id for r in rows.values()}) and all(r.doc_id == rows[r.doc_id].class_id for r in kept)


def test_large_buckets_are_led(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 5)
    base = prose(5, 200)
    docs = spark.createDataFrame([(i, edited(base, i, 0.01)) for i in range(40)] + [(100, prose(9))], "doc_id long, text string")
    found, _ = neardup.near_duplicates(docs)
    assert {r.class_id for r in found.collect()} == {0, 100}


def test_chains_in_large_buckets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 5)
    r, texts, base = random.Random(4), [], prose(50, 200).split()
    replaced = lambda words, n: [f"q{r.randint(0, 10**9)}" if i in hit else w for hit in [set(r.sample(range(len(words)), n))] for i, w in enumerate(words)]
    for _ in range(6):  # a chain of six texts, each with many copies
        texts += [" ".join(replaced(base, 1 + j % 3)) for j in range(40)]
        base = replaced(base, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, links = neardup.near_duplicates(docs, recall=0.999)
    got = {(r.a, r.b) for r in links.collect()}
    s = sets([t.lower() for t in texts])
    want = {(a, b) for a, b in combinations(range(len(s)), 2) if len(s[a] & s[b]) >= 0.7 * min(len(s[a]), len(s[b]))}
    assert got <= want and len(want - got) <= 0.01 * len(want)
    assert links.count() == len(got)
    for r in found.collect():
        assert r.class_id == 0 and r.n_links == sum(r.doc_id in x for x in got)


def test_containment_at_any_size_against_brute_force(spark):
    texts = [prose(k, 120) for k in range(60)]
    for k in range(20):
        words = texts[k].split()
        texts.append(" ".join(words[10 : 20 + 4 * k]))  # an excerpt
        texts.append(texts[k] + "\n" + prose(900 + k, 60 + 40 * k))  # an appended section
        texts.append(prose(700 + k, 300) + "\n" + edited(texts[k], k, 0.05) + "\n" + prose(800 + k, 600))  # quoted with edits
    texts.append("\n".join(texts[20:60]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, links = neardup.near_duplicates(docs, recall=0.999)
    got = {(r.a, r.b): r.containment for r in links.collect()}
    s = sets([t.lower() for t in texts])
    share = {(a, b): len(s[a] & s[b]) / min(len(s[a]), len(s[b])) for a, b in combinations(range(len(s)), 2)}
    want = {p: c for p, c in share.items() if c >= 0.7}
    assert len(want) > 100 and links.count() == len(got)
    # links by profile tell the least containment
    assert got.keys() <= want.keys() and all(0.7 - 1e-9 <= c <= want[p] for p, c in got.items()) and len(want.keys() - got.keys()) <= 0.01 * len(want)
    rows = {r.doc_id: r for r in found.collect()}
    assert all(r.n_links == sum(r.doc_id in p for p in got) for r in rows.values())


def test_asks_find_containing_sets():
    r = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.5, 0.65, 0.9, 1.0):  # of hot elements
        hits = 0
        for _ in range(1500):
            e = np.sort(r.choice(1 << 47, 60, replace=False))
            hot = np.sort(r.permutation(e)[: int(60 * share)])
            # the worst case: the other set holds all hot elements it can
            other = set(np.r_[r.permutation(hot), r.permutation(np.setdiff1d(e, hot))][:42].tolist())
            asked, n, must, common, heavy = neardup.asks(e, np.array([60]), hot, 0.7, 0.99)
            assert len(asked) == n[0] <= 40 and common.sum() == len(hot) and heavy[0] == (len(hot) >= 42)
            hits += len(other & set(asked.tolist())) >= must[0] or (heavy[0] and len(other & set(hot.tolist())) >= 42)
        assert hits >= 0.98 * 1500


def test_a_passage_of_many_texts_against_brute_force(spark):
    passage = prose(4000, 80)
    texts = [prose(k, 60 + 7 * k) + "\n" + passage for k in range(30)] + [passage + "\n" + prose(500 + k, 3 + 3 * k) for k in range(12)]
    texts += [passage, *(prose(k, 150) for k in range(600, 610)), prose(601, 150) + "\n" + passage + "\n" + prose(900, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, links = neardup.near_duplicates(docs, recall=0.999)
    s = sets([t.lower() for t in texts])
    want = {(a, b) for a, b in combinations(range(len(s)), 2) if len(s[a] & s[b]) >= 0.7 * min(len(s[a]), len(s[b]))}
    got = {(r.a, r.b) for r in links.collect()}
    assert len(want) > 200 and got == want and links.count() == len(got)
    assert all(r.n_links == sum(r.doc_id in p for p in want) for r in found.collect())


def test_scripts_without_spaces(spark):
    r = random.Random(8)
    make = lambda n, low=0x4E00: "".join(chr(r.randint(low, low + 400)) for _ in range(n))
    a, b, c = make(800), make(300, 0x0E01), make(200)
    cut = lambda t, k: t[:k] + "々" * 5 + t[k + 5 :]
    texts = [a, cut(cut(a, 100), 500), b, cut(b, 50), c, make(700) + c + make(100), "mixed 中文 words 日本 here", "mixed 中文 words 日本 there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, links = neardup.near_duplicates(docs, recall=0.999)
    assert {(r.a, r.b) for r in links.collect()} == {(0, 1), (2, 3), (4, 5), (6, 7)}
    assert {r.doc_id: r.class_id for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 6}


def test_texts_that_share_an_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, prose(1)), (1, prose(2)), (2, prose(3)), (3, prose(1))], "doc_id long, text string")
    assert sorted(r.text for r in neardup.keep_one(docs).collect()) == sorted([prose(1), prose(2), prose(3)])
    named = spark.createDataFrame([("x", prose(1)), ("b", prose(1) + " end"), (None, prose(2))], "doc_id string, text string")
    assert sorted((r.doc_id or "") for r in neardup.keep_one(named).collect()) == ["", "b"]


@pytest.mark.parametrize("local", [1, 64])
def test_hot_buckets_of_one_task(spark, monkeypatch, local):
    monkeypatch.setattr(neardup, "LOCAL", local)
    base = prose(5, 200)
    texts = [edited(base, i, 0.01) for i in range(40)]
    n = len(set(texts))
    found, links = neardup.near_duplicates(spark.createDataFrame([*enumerate(texts), (100, prose(9))], "doc_id long, text string").repartition(3))
    assert {r.class_id for r in found.collect()} == {0, 100} and links.count() == n * (n - 1) // 2


def test_overlaps_against_brute_force():
    r = np.random.default_rng(1)
    own = [set(r.integers(0, 300, k).tolist()) for k in (50, 1, 120, 7, 90, 30)]
    elements, which = np.concatenate([sorted(s) for s in own]), np.repeat(np.arange(6), [len(s) for s in own])
    for left, right in (([0, 2, 4], [1, 3, 5]), ([5, 1, 2], [5, 1, 2])):
        got = neardup.overlaps(elements, which, np.array(left), np.array(right), width=16)
        assert all(got[i, j] == len(own[a] & own[b]) for i, a in enumerate(left) for j, b in enumerate(right) if a != b)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (90, 101)], "a long, b long")
    got = {r.id: r.group for r in neardup.components(chain).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (90, 100, 101)} == {90}


def test_the_driver_holds_few_edges_and_no_filter(spark, monkeypatch):
    joined, sent, gather, broadcast = [], [], neardup.gather, spark.sparkContext.broadcast
    monkeypatch.setattr(neardup, "gather", lambda a, b: joined.append(len(a)) or gather(a, b))
    pairs = spark.range(25_000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    label = neardup.components(pairs)
    assert label.where("group = id - id % 2").count() == label.count() == 50_000 and sum(joined) <= 20_000
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x.dtype) or broadcast(x))
    docs = spark.createDataFrame([(0, prose(1, 60)), (1, prose(1, 60) + "\n" + prose(2, 600)), (2, prose(3, 600))], "doc_id long, text string")
    assert [(r.a, r.b) for r in neardup.near_duplicates(docs)[1].collect()] == [(0, 1)]
    assert sent == [np.int64]  # the elements of many texts


class Tasks:
    """Stands for a DataFrame and keeps the functions that its tasks would run."""

    def __init__(self, spark):
        self.sparkSession, self.run = spark, []

    def mapInArrow(self, f, schema):
        self.run.append(f)
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def most_mb(run, batch):
    """Peak MB of what a task holds beside its batch, whose results go as they come."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        n = sum(b.num_rows for b in run(iter([batch])))
        return n, (tracemalloc.get_traced_memory()[1] - before) / 1e6
    finally:
        tracemalloc.stop()


def test_tasks_hold_little_beside_their_texts(spark):
    r = np.random.default_rng(5)
    texts = [" ".join(map(str, r.integers(10**5, 10**6, 300))) for _ in range(4000)]  # 8 MB
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(texts)], ["h1", "t"])
    rows = Tasks(spark)
    neardup._met(rows, 10**6, 0.7, 0.7, 0.99)
    n, mb = most_mb(rows.run[0], batch)
    assert n >= 64 and mb < 25
    rows = Tasks(spark)
    neardup._asked(rows, np.zeros(0, np.int64), 0.7, 0.99)
    n, mb = most_mb(rows.run[0], batch)
    assert n >= 4 * 4000 and mb < 25


def test_pieces_of_any_size_give_the_same_links(spark, monkeypatch):
    base = prose(5, 200)
    texts = [edited(base, i, 0.01) for i in range(90)] + [edited(prose(k, 150), j, 0.02) for k in range(30, 50) for j in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(neardup, "LOCAL", 8)

    def links():
        found, pairs = neardup.near_duplicates(docs, recall=0.999)
        return {(r.a, r.b, r.containment) for r in pairs.collect()}, {tuple(r) for r in found.collect()}

    whole = links()
    monkeypatch.setattr(neardup, "PIECE", 1 << 8)
    assert links() == whole and len(whole[0]) > 2900


def test_near_duplicates_of_odd_tables(nasty, empty):
    kept = neardup.keep_one(nasty)
    assert kept.columns == nasty.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 13] and sum(r.doc_id is None for r in rows) == 1
    assert neardup.near_duplicates(nasty)[0].count() == nasty.count()
    assert neardup.keep_one(empty).count() == 0


def words(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n)]


def shuffled(spark, run):
    """(result, records that its stages wrote for others)."""
    store, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()

    def records():
        store.listenerBus().waitUntilEmpty()
        got = store.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (got.apply(i) for i in range(got.size()))}

    before = records()
    return run(), sum(n for k, n in records().items() if k not in before)


def test_common_elements_dont_pair_all_their_sets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_hot", lambda *a, **k: np.zeros(0, np.int64))
    passage = words(0, 8)
    short = [words(1 + i, 40) + passage for i in range(300)]
    long = [words(1001 + i, 300) + passage + (short[i] if i < 20 else []) for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(short + long)], "doc_id long, text string")
    links, n = shuffled(spark, lambda: neardup.near_duplicates(docs, recall=0.999)[1].collect())
    assert sorted((r.a, r.b) for r in links) == [(i, 300 + i) for i in range(20)] and all(r.containment == 1 for r in links)
    assert n < 100_000  # 90,000 pairs share the passage, and two or three of its elements are asked for


def test_sets_of_hot_and_other_elements(spark):
    # of the first text most is hot; the second has three of its four passages and what isn't hot, the third one passage and that
    hot = [words(k, 12) for k in range(4)]
    own = words(5, 10)
    texts = [sum(hot, []) + own, words(6, 80) + hot[0] + hot[1] + hot[2] + words(7, 3) + own, words(8, 90) + hot[3] + own, *(words(100 + k, 60) + hot[k % 4] for k in range(60))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    want = {(i, j): len(x & y) / min(len(x), len(y)) for (i, x), (j, y) in combinations(enumerate(sets), 2) if len(x & y) >= 0.7 * min(len(x), len(y))}
    found, links = neardup.near_duplicates(docs, recall=0.999)
    got = {(r.a, r.b): r.containment for r in links.collect()}
    assert set(want) == {(0, 1)} and got == pytest.approx(want)
    assert {r.doc_id: r.n_links for r in found.collect() if r.n_links} == {0: 1, 1: 1}


def test_the_filter_of_elements(spark, monkeypatch):
    r = np.random.default_rng(1)
    some, others = np.unique(r.integers(0, 1 << 48, 20_000)), r.integers(0, 1 << 48, 20_000)
    table = spark.createDataFrame(pa.table({"element": some}))
    files, pages = neardup._write_mask(table, "mask")
    mask = neardup._mask(files, pages)
    assert len(neardup._passing(mask, some)) == len(some) and len(neardup._passing(mask, others)) < 400
    monkeypatch.setattr(neardup, "MASK", 8 << 10)  # one page: 3 bits an element
    files, pages = neardup._write_mask(table, "mask")
    assert pages == 1 and len(neardup._passing(neardup._mask(files, pages), some)) == len(some)
    monkeypatch.setattr(neardup, "MASK", 1 << 10)
    assert neardup._write_mask(table, "mask") == ([], 0) and len(neardup._passing(neardup._mask([], 0), others)) == len(others)


def test_lines_that_dont_recur_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 0)
    # 300 texts with a template and 12,000 lines of their own, 300 texts of 12,000 lines without it
    rows = [(i, prose(i, 480) + ("\n" + boiler(i)) * (i < 300)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out, n = shuffled(spark, lambda: linededup.dedup_lines(docs).collect())
    assert {r.doc_id: r.n_dropped for r in out} == {i: int(i < 300) for i in range(600)}
    assert n < 95_000


def test_filter_of_numbers(spark, monkeypatch):
    r = np.random.default_rng(3)
    some, others = (r.integers(-(1 << 63), 1 << 63, 5000) for _ in range(2))
    frame = lambda x: spark.createDataFrame(pa.table({"k": x}))
    every, right = frame(np.r_[some, others]), frame(some)
    got = {x.k for x in linededup._maybe(every, right, "k").collect()}
    assert got >= set(some.tolist()) and len(got) < 5500
    monkeypatch.setattr(linededup, "BITS", 64)
    assert linededup._maybe(every, right, "k").count() == 10_000 and linededup._maybe(every, right.limit(0), "k").count() == 0


def test_lookups_of_sets_arent_sent_to_the_driver(spark):
    docs = spark.createDataFrame([(i, prose(i)) for i in range(40)], "doc_id long, t string").select(F.xxhash64("t").alias("h1"), "t")
    where = docs.where("h1 % 2 = 0").select(F.col("h1").alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("task"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # what is small by its size may be broadcast
    try:
        out = neardup._sets(docs, where)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.id, r.task): r.set for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {r.h1: neardup.shingles(*as_text(pa.array([r.t])))[0].tolist() for r in docs.collect() if r.h1 % 2 == 0}
    assert got == {(h, t): s for h, s in want.items() for t in (1, 2)} and want
