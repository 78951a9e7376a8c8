import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossmill.llm import mixing, sharding


def whole(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    return by


def test_shards_are_even_and_a_hot_group_is_divided(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7 + 1)) for i in range(6000)], "doc_id long, text string")
    rows = sharding.shard(docs, 24).collect()
    whole(rows, 24)
    size = Counter()
    for r in rows:
        size[r.shard] += len(r.text) + 8
    mean, largest = sum(size.values()) / 24, max(len(r.text) + 8 for r in rows)
    assert len(rows) == 6000 and max(size.values()) - min(size.values()) <= 2 * max(largest, 0.01 * mean) + 0.004 * mean
    groups = defaultdict(set)
    for r in rows:
        groups[r.text].add(r.shard)
    assert {t for t, s in groups.items() if len(s) > 1} <= {"same text"}


def test_shards_of_odd_tables(nasty, empty):
    clash = sharding.shard(nasty, 3)
    assert clash.columns == [*nasty.columns, "_shard", "_slot"] and clash.count() == nasty.count()
    whole([r for r in nasty.drop("shard", "slot").transform(lambda d: sharding.shard(d, 5)).collect()], 5)
    assert sharding.shard(empty.drop("shard", "slot"), 4).count() == 0


def test_fine_ranges_keep_slots_gapless(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    by = whole(sharding.shard(docs, 4, task_bytes=2000).collect(), 4)
    assert max(map(len, by.values())) - min(map(len, by.values())) < 20


def test_a_hot_text_is_ordered_by_several_tasks(spark):
    docs = spark.createDataFrame([(f"id{i}", "hot" * 20 if i % 3 else f"text {i}") for i in range(3000)], "doc_id string, text string")
    rows = sharding.shard(docs, 4, task_bytes=3000).collect()
    by = whole(rows, 4)
    size = Counter()
    for r in rows:
        size[r.shard] += len(r.text) + 8
    assert len(by) == 4 and len(rows) == 3000 and max(size.values()) - min(size.values()) <= 0.02 * sum(size.values())


def test_splitters_of_many_shards_are_fast(spark):
    import time

    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    began = time.time()
    by = whole(sharding.shard(docs, 1500).collect(), 1500)
    assert len(by) > 1400 and time.time() - began < 120


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 10], [1, 2, 3], 30, 3) == [5, 10, 15]
    got = mixing.targets([1, 100, 0], [1, 1, 1], 101, 3)
    assert got == [3, 98, 0]
    assert mixing.targets([], [], 0, 3) == []


def brute(supply, members, quota, costs):
    """Greatest flow, then least cost, over all integer flows of tiny instances."""
    pairs = [(p, s) for p, m in enumerate(members) for s in m]
    best = None
    for f in itertools.product(*[range(quota[s] + 1) for _, s in pairs]):
        out, into = Counter(), Counter()
        for (p, s), v in zip(pairs, f, strict=True):
            out[p] += v
            into[s] += v
        if any(into[s] > quota[s] for s in range(len(quota))) or any(out[p] > len(costs) * supply[p] for p in range(len(supply))):
            continue
        cost = sum(sum(min(max(out[p] - k * supply[p], 0), supply[p]) * c for k, c in enumerate(costs)) for p in range(len(supply)))
        key = (-sum(f), cost)
        best = key if best is None or key < best else best
    return best


def test_flow_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(25):
        supply, quota = r.integers(0, 3, 3).tolist(), r.integers(0, 4, 2).tolist()
        members = [[0], [1], [0, 1]]
        flow = mixing.route(supply, members, quota)
        out = Counter()
        for (p, _), v in flow.items():
            out[p] += v
        cost = sum(sum(min(max(out[p] - k * supply[p], 0), supply[p]) * c for k, c in enumerate(mixing.COSTS)) for p in range(3))
        assert (-sum(flow.values()), cost) == brute(supply, members, quota, mixing.COSTS)


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = spark.createDataFrame([(i, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "c"], i % 40 + 1) for i in range(3000)], "doc_id long, members array<string>, size long")
    out, sources = mixing.mix(docs)
    rows = out.collect()
    want = sum(t for _, _, t in sources)
    assert len(rows) == 3000 and abs(sum(r.taken for r in rows) - want) <= 3 * 3 and max(r.copies for r in rows) <= 3
    again, _ = mixing.mix(docs.repartition(7))
    assert sorted(again.collect()) == sorted(rows)


def test_mix_of_odd_tables(nasty, empty):
    sized = lambda d: d.drop("size").withColumns({"belong": F.array("source"), "words": mixing.words("text")})
    out, sources = mixing.mix(sized(nasty), "belong", size="words")
    assert out.count() == nasty.count() and sources[-1][0] is None
    assert mixing.mix(sized(empty), "belong", size="words")[0].count() == 0
    for some in (nasty, empty):
        both, supply = mixing.shared_texts(sized(some), size="words", to="belong")
        out, sources = mixing.mix(both, "belong", size="words", own="source", supply=supply)
        rows = out.collect()
        assert len(rows) == some.count() and all(r.copies <= 3 for r in rows)


def test_texts_of_several_sources_serve_where_they_are_needed(spark):
    r = random.Random(1)
    rows = [(i, f"own text {i} " + "x " * r.randint(1, 30), "abc"[i % 3]) for i in range(900)]
    rows += [(1000 + 3 * i + k, f"shared text {i} " + "y " * r.randint(1, 30), s) for i in range(200) for k, s in enumerate("ab")]
    rows += [(5000 + i, "a hot text of many rows", "abc"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.words("text"))
    both, supply = mixing.shared_texts(docs)
    assert {tuple(x.members): x.size for x in supply.collect()}.keys() == {("a",), ("b",), ("c",), ("a", "b")}
    out, sources = mixing.mix(both, own="source", supply=supply)
    got = out.collect()
    taken = Counter()
    for x in got:
        assert x.taken == x.copies * x.size and x.copies <= 3
        taken[x.source] += x.taken
    assert all(abs(taken[s] - goal) <= 10 for s, _, goal in sources) and len(got) == len(rows)
    few, _ = mixing.mix(both, own="source", supply=supply, max_patterns=2)
    again = Counter()
    for x in few.collect():
        again[x.source] += x.taken
    assert all(abs(again[s] - goal) <= 10 for s, _, goal in sources)


def test_a_document_beyond_the_target_is_made_up_for(spark):
    # where the largest document of a comes last in the seeded order, only it fills the gap, with too much
    sizes = [108, 226, 272, 324, 327, 376, 1386]
    docs = lambda k: spark.createDataFrame([(100 * k + i, [f"a{k}"], n) for i, n in enumerate(sizes)], "doc_id long, members array<string>, size long")
    some = docs(0)
    for k in range(1, 30):
        some = some.union(docs(k))
    out, sources = mixing.mix(some, weights=lambda names: [1 + 2 * (i % 2) for i in range(len(names))])
    taken = Counter()
    for r in out.collect():
        taken[r.members[0]] += r.taken
    assert all(abs(taken[s] - goal) <= 150 for s, _, goal in sources)


def test_patterns_beyond_the_drivers_take_part(spark):
    # only the texts that a shares with others can serve them where these run short
    rows = [(i, ["a", "b"] if i % 4 == 0 else ["a", "c"] if i % 4 == 1 else ["a"], i % 9 + 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    out, sources = mixing.mix(docs)
    few, same = mixing.mix(docs, max_patterns=1)
    assert same == sources and sorted(few.collect()) == sorted(out.collect())


def test_flow_with_room_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(25):
        supply, quota = r.integers(0, 3, 3).tolist(), r.integers(0, 4, 2).tolist()
        members = [[0], [1], [0, 1]]
        room = {(p, s): int(r.integers(0, 5)) for p, m in enumerate(members) for s in m}
        flow = mixing.route(supply, members, quota, room=room)
        best = None
        pairs = list(room)
        price = lambda p, v: sum(k // supply[p] * (k // supply[p] + 1) // 2 for k in range(v)) if supply[p] else 0  # noqa: B023, E731
        for f in itertools.product(*[range((room[k] if supply[k[0]] else 0) + 1) for k in pairs]):
            out, into = Counter(), Counter()
            for (p, s), v in zip(pairs, f, strict=True):
                out[p] += v
                into[s] += v
            if all(into[s] <= quota[s] for s in range(2)):
                key = (-sum(f), sum(price(p, v) for p, v in out.items()))
                best = key if best is None or key < best else best
        out = Counter()
        for (p, _), v in flow.items():
            out[p] += v
        assert (-sum(flow.values()), sum(price(p, v) for p, v in out.items())) == best and all(v <= room[k] for k, v in flow.items())


def test_flow_of_many_patterns_is_fast():
    import time

    r = np.random.default_rng(3)
    members = [sorted(set(r.integers(0, 40, 3).tolist())) for _ in range(5000)]
    began = time.time()
    flow = mixing.route(r.integers(1, 1000, 5000).tolist(), members, [60_000] * 40)
    assert sum(flow.values()) == 40 * 60_000 and time.time() - began < 60


def test_the_plan_of_a_mix_needs_no_python_workers(spark):
    docs = spark.createDataFrame(pa.table({"doc_id": list(range(60)), "members": [[f"s{k % 3}"] for k in range(60)], "size": [5 + k % 7 for k in range(60)]}))
    out, _ = mixing.mix(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Python" not in plan
    assert out.count() == 60
