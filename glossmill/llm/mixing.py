"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold their text).  Token
capacity flows from patterns to source quotas; the first pass over a pattern's texts is free, each
repetition costs more than the one before.  The flow runs over the small table of patterns; the
documents that give a source's share of a pattern are then chosen by a seeded order.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table, write_shared

COSTS = (0, 1, 3)


def targets(sizes: list[int], weights: list[float], total: int, most: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out, free, rest = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(total)
    weights = [Fraction(w) for w in weights]
    while free and rest > 0:
        of = sum(weights[i] for i in free)
        if not of:
            break
        full = {i for i in free if rest * weights[i] / of > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = rest * weights[i] / of
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            rest -= out[i]
        free -= full
    return [float(x) for x in out]


def passes(supply: int, room: int, costs=None) -> list[tuple[int, int]]:
    """(capacity, cost a word) of the passes over a pattern, up to ``room`` words.

    The k-th pass costs k (k + 1) / 2 a word, or costs[k]; from the ninth on, several passes share a cost.
    """
    out, k = [], 0
    while supply > 0 and room > 0 and (costs is None or k < len(costs)):
        many = 1 if k < 8 or costs is not None else k // 4
        some = min(room, many * supply)
        out.append((some, k * (k + 1) // 2 if costs is None else costs[k]))
        room -= some
        k += many
    return out


def route(supply: list[int], members: list[list[int]], quota: list[int], costs=COSTS, room: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Words that each pattern gives to each source: a flow of greatest value and, of these, least cost.

    A pattern may be used len(costs) times, the k-th time at costs[k] a word; with ``room`` (the most
    that a source may take of a pattern), as often as that allows, see passes().  Shortest paths with
    potentials over start -> (pattern, parallel arcs) -> quotas -> end; all paths of one length are
    filled at once.
    """
    np_, ns = len(supply), len(quota)
    src, sink = np_ + ns, np_ + ns + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(np_ + ns + 2)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
        return len(to) - 2

    link = {}
    for p in range(np_):
        most = {s: sum(quota) + 1 if room is None else room[p, s] for s in members[p]}
        for c, w in passes(supply[p], len(costs) * supply[p], costs) if room is None else passes(supply[p], sum(most.values())):
            arc(src, p, c, w)
        for s, c in most.items():
            link[p, s] = arc(p, np_ + s, c, 0)
    for s in range(ns):
        arc(np_ + s, sink, quota[s], 0)
    height = [0] * len(out)
    while True:
        far: list[int | None] = [None] * len(out)
        far[src] = 0
        heap = [(0, src)]
        while heap:
            x, a = heapq.heappop(heap)
            if x > far[a]:
                continue
            for e in out[a]:
                if cap[e] > 0:
                    y = x + cost[e] + height[a] - height[to[e]]
                    if far[to[e]] is None or y < far[to[e]]:
                        far[to[e]] = y
                        heapq.heappush(heap, (y, to[e]))
        if far[sink] is None:
            break
        top = far[sink]
        for a in range(len(out)):
            height[a] += top if far[a] is None else min(far[a], top)
        _fill(out, to, cap, cost, height, src, sink)
    return {k: cap[e ^ 1] for k, e in link.items() if cap[e ^ 1]}


def _fill(out, to, cap, cost, height, src, sink) -> None:
    """Fills all paths of reduced cost 0 from src to sink."""
    while True:
        level = [-1] * len(out)
        level[src] = 0
        queue = [src]
        for a in queue:
            for e in out[a]:
                b = to[e]
                if level[b] < 0 and cap[e] > 0 and cost[e] + height[a] == height[b]:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            return
        at = [0] * len(out)
        path: list[int] = []
        a = src
        while True:
            if a == sink:
                push = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= push
                    cap[e ^ 1] += push
                first = next(k for k, e in enumerate(path) if cap[e] == 0)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > 0 and level[to[e]] == level[a] + 1 and cost[e] + height[a] == height[to[e]]:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def by_code_point(names: list) -> list:
    return sorted(names, key=lambda x: (x is None, x or ""))


def words(text):
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_texts(docs: DataFrame, text: str = "text", source: str = "source", size: str = "size", to: str = "members") -> tuple[DataFrame, DataFrame]:
    """(docs with the sources whose rows hold an equal text, words of different texts by these: ``members``, ``size``).

    Copies are counted before they move; texts of one source are never joined.
    """
    names = docs.columns
    h, salt, got = (fresh(names, x) for x in ("_h", "_salt", "_got"))
    keyed = docs.withColumns({h: F.xxhash64(text), salt: F.pmod(F.xxhash64(*[c for c in names if c != text][:2] or [F.lit(0)]), F.lit(16)).cast("int")})
    kinds = F.transform(F.collect_set(F.struct(F.col(source).cast("string").alias("s"))), lambda x: x["s"])
    texts = write_shared(keyed.groupBy(F.col(h).alias("h")).agg(F.array_sort(kinds).alias("members"), F.max(size).alias("size")), "texts")
    several = texts.where(F.size("members") > 1).select(F.col("h").alias(h), F.col("members").alias(got), F.explode(F.sequence(F.lit(0), F.lit(15))).alias(salt))
    out = keyed.join(several, [h, salt], "left").withColumn(to, F.coalesce(got, F.array(F.col(source).cast("string"))))
    return out.select(*[c for c in names if c != to], to), texts.groupBy("members").agg(F.sum("size").alias("size"))


def _code(pattern):
    return F.to_json(F.struct(pattern.alias("p")), {"ignoreNullFields": "false"})


def _plan(cells, at: dict, goal: list[float], own: bool, most: int) -> list[tuple]:
    """(p, own, whole passes, words beyond these) of each cell, by the flow; cells: (p, own, size, members, told)."""
    cells = sorted(cells, key=lambda x: (x[0], x[1] is None, x[1] or ""))
    place: dict[str, int] = {}
    full: list[int] = []
    told: list[int | None] = []
    belong: list[list[int]] = []
    room: dict[tuple[int, int], int] = {}
    for p, mine, size, members, words_of in cells:
        if p not in place:
            place[p] = len(full)
            full.append(0), told.append(words_of), belong.append([])
        k = place[p]
        full[k] += size
        for s in [mine] if own else members:
            belong[k].append(at[s])
            room[k, at[s]] = most * size
    flow = route([min(f, t or f) for f, t in zip(full, told, strict=True)], belong, [round(g) for g in goal], tuple(k * (k + 1) // 2 for k in range(most)), room if own else None)
    use: dict[tuple[int, int | None], int] = {}
    for (p, s), v in flow.items():
        k = (p, s if own else None)
        use[k] = use.get(k, 0) + v
    out = []
    for p, mine, size, _, _ in cells:
        v = use.get((place[p], at[mine] if own else None), 0)
        whole = min(most, v // size) if size else 0
        out.append((p, mine, whole, v - whole * size))
    return out


PLAN = "p string, own string, passes int, rest long"


def _plan_table(rows: list[tuple]) -> pa.Table:
    """PLAN, as an Arrow table."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["p", "own", "passes", "rest"])


def mix(docs: DataFrame, members: str = "members", size: str = "size", key: str = "doc_id", own: str | None = None, supply: DataFrame | None = None, weights=None, most: int = 3, seed: int = 1, rounds: int = 4, bits: int = 12, max_patterns: int = 50_000) -> tuple[DataFrame, list[tuple]]:
    """docs with ``taken`` (words the mix takes, whole documents, repeats counted) and ``copies``.

    members: array of the sources that hold a document (null or empty: the source null).  own: column of
    the one source that a row belongs to, where several rows hold a text (see shared_texts(), which also
    makes ``supply``); without it a row serves any of its members.  All patterns take part in the flow:
    where patterns by own source are at most ``max_patterns``, the flow runs in the driver and what it
    gives is broadcast; of more, it runs in one task and is joined, so that the driver never holds them.
    Documents of size 0 are neither needed nor dropped: they follow their pattern's whole passes.  Ties
    in the seeded order go by id; rows equal in id and size are interchangeable.  An empty table gives an
    empty result.  Returns (docs, sources) where sources lists (source, size, target).
    """
    spark = docs.sparkSession
    names = docs.columns
    cell, r = (fresh(names, x) for x in ("_cell", "_r"))
    pattern = F.when(F.coalesce(F.size(members), F.lit(0)) <= 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(members)))
    mine = F.col(own).cast("string") if own else F.lit(None).cast("string")
    draw = F.xxhash64(F.lit(seed), F.col(key), F.lit("mix"))
    keys = write_shared(docs.select(_code(pattern).alias("p"), mine.alias("own"), F.col(size).cast("long").alias("size"), draw.alias("r"), F.col(key).cast("string").alias("id"), pattern.alias("members")), "mix-keys")
    totals = keys.groupBy("p", "own").agg(F.sum("size").alias("size"), F.first("members").alias("members"))
    if supply is None:
        totals = totals.withColumn("told", F.lit(None).cast("long"))
    else:
        totals = totals.join(supply.select(_code(F.col("members")).alias("p"), F.col("size").cast("long").alias("told")), "p", "left")
    totals = write_shared(totals, "mix-totals")
    keys = keys.withColumn("cell", F.concat("p", _code(F.col("own")))).drop("members")
    of = totals.select(F.col("own") if own else F.explode("members").alias("own"), "size").groupBy("own").agg(F.sum("size").alias("size"))
    sizes = {x["own"]: x["size"] for x in of.collect()}
    sources = by_code_point(list(sizes))
    at = {s: i for i, s in enumerate(sources)}
    total = totals.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    goal = targets([sizes[s] for s in sources], (weights or (lambda names: [1 + i % 3 for i in range(len(names))]))(sources), total, most)
    cells = totals.select("p", "own", "size", "members", "told")
    one = own is not None
    if totals.count() <= max_patterns:
        near = F.broadcast
        # an Arrow table stays with the JVM: of a list, every task that reads it would start a Python worker
        small = spark.createDataFrame(_plan_table(_plan([tuple(x) for x in cells.collect()], at, goal, one, most)), PLAN)
    else:
        near = lambda df: df.hint("merge")

        def run(group: pa.Table) -> pa.Table:
            return _plan_table(_plan(zip(*[c.to_pylist() for c in group.columns], strict=True), at, goal, one, most))

        small = write_shared(cells.groupBy().applyInArrow(run, PLAN), "mix-plan")
    small = small.withColumn("cell", F.concat("p", _code(F.col("own")))).drop("p", "own")
    picks = small.join(_choose(keys, small, rounds, bits, near), "cell", "left")  # as many rows as cells
    took = {c: fresh([*names, cell, r], f"_{c}") for c in ("passes", "rest", "bucket", "last_r", "last_id", "added", "left_out")}
    picks = picks.select(F.col("cell").alias(cell), *[F.col(c).alias(n) for c, n in took.items()])
    t = {c: F.col(n) for c, n in took.items()}
    r_, k_ = F.col(r), F.col(key).cast("string")
    first = F.coalesce(t["bucket"], F.lit(-1))
    bucket = F.shiftrightunsigned(r_, 64 - bits)
    under = (bucket < first) | ((bucket == first) & (F.struct(r_, k_) <= F.struct(t["last_r"], t["last_id"])))
    among = lambda c: F.coalesce(F.array_contains(t[c], F.struct(r_.alias("r"), k_.alias("id"))), F.lit(False))
    copies = t["passes"] + F.when((t["rest"] > 0) & (F.coalesce(under, F.lit(False)) | among("added")) & ~among("left_out"), 1).otherwise(0)
    out = docs.withColumns({cell: F.concat(_code(pattern), _code(mine)), r: draw}).join(near(picks), cell)
    out = out.withColumn(r, copies)
    return out.select(*[c for c in names if c not in ("copies", "taken")], F.col(r).alias("copies"), (F.col(r) * F.col(size)).alias("taken")), [(s, sizes[s], g) for s, g in zip(sources, goal, strict=True)]


def _choose(keys: DataFrame, plan: DataFrame, rounds: int, bits: int, near) -> DataFrame:
    """Per cell, documents in seeded order whose words come next below ``rest``.

    cell, bucket (whole buckets below it are taken), last_r and last_id (of the last taken one in it),
    added (documents that fill what remains: largest first, and one that may go a little beyond it),
    left_out (documents taken so far that make up for that one: largest first).
    The order is cut into 2^bits buckets: only the one that holds the boundary is sorted.  near: hint for
    joins with a row per cell.
    """
    b = F.shiftrightunsigned("r", 64 - bits)
    keys = keys.select("cell", "size", "r", "id").join(near(plan.where("rest > 0")), "cell").withColumn("b", b)
    w = Window.partitionBy("cell").orderBy("b")
    sums = keys.groupBy("cell", "b", "rest").agg(F.sum("size").alias("in_bucket")).withColumn("upto", F.sum("in_bucket").over(w))
    edge = sums.where("upto > rest and upto - in_bucket <= rest").select("cell", F.col("b").alias("bucket"), (F.col("upto") - F.col("in_bucket")).alias("below"))
    edge = write_shared(edge, "mix-edge")  # a row per cell
    inside = keys.join(near(edge), "cell").where("b = bucket").groupBy("cell", "bucket", "below", "rest", "r", "id").agg(F.sum("size").alias("size"))
    w = Window.partitionBy("cell").orderBy("r", "id")
    inside = inside.withColumn("upto", F.col("below") + F.sum("size").over(w)).where("upto <= rest")
    last = inside.groupBy("cell").agg(F.max(F.struct("r", "id", "upto")).alias("m"))
    none = F.array().cast("array<struct<r:long,id:string>>")
    state = edge.join(last, "cell", "left").join(plan.select("cell", "rest"), "cell").select("cell", "bucket", F.col("m.r").alias("last_r"), F.col("m.id").alias("last_id"), F.coalesce("m.upto", "below").alias("have"), "rest", none.alias("added"))
    state = write_shared(state, "mix-state")
    k = 0
    while k <= rounds and not (now := state.where("have < rest").drop("rest")).isEmpty():
        under = (F.col("b") < F.col("bucket")) | ((F.col("b") == F.col("bucket")) & F.coalesce(F.struct("r", "id") <= F.struct("last_r", "last_id"), F.lit(False)))
        gap = F.col("rest") - F.col("have")
        # at last, one that leaves less above the target than is missing below it
        fits = F.col("size") <= gap if k < rounds else (F.col("size") > gap) & (F.col("size") < 2 * gap)
        left = keys.join(near(now), "cell").where(~under & (F.col("size") > 0) & fits & ~F.array_contains("added", F.struct("r", "id")))
        sums = left.groupBy("cell", "r", "id").agg(F.sum("size").alias("size"), F.max(gap).alias("gap")).where("size <= gap" if k < rounds else "size < 2 * gap")
        pick = F.max(F.struct("size", "r", "id")) if k < rounds else F.min(F.struct("size", "r", "id"))
        best = write_shared(sums.groupBy("cell").agg(pick.alias("m")), "mix-best")
        if best.isEmpty():
            k = rounds if k < rounds else rounds + 1
            continue
        more = F.when(F.col("m").isNull(), F.col("added")).otherwise(F.concat("added", F.array(F.struct("m.r", "m.id"))))
        state = state.join(near(best), "cell", "left").select("cell", "bucket", "last_r", "last_id", (F.col("have") + F.coalesce("m.size", F.lit(0))).alias("have"), "rest", more.alias("added"))
        state = write_shared(state, "mix-state")
        k += 1
    state = state.withColumn("left_out", none)
    for _ in range(rounds):
        if (now := state.where("have > rest").drop("rest")).isEmpty():
            break
        under = (F.col("b") < F.col("bucket")) | ((F.col("b") == F.col("bucket")) & F.coalesce(F.struct("r", "id") <= F.struct("last_r", "last_id"), F.lit(False)))
        this, beyond = F.struct("r", "id"), F.col("have") - F.col("rest")
        held = keys.join(near(now), "cell").where((under | F.array_contains("added", this)) & (F.col("size") > 0) & (F.col("size") <= beyond) & ~F.array_contains("left_out", this))
        sums = held.groupBy("cell", "r", "id").agg(F.sum("size").alias("size"), F.max(beyond).alias("beyond")).where("size <= beyond")
        best = write_shared(sums.groupBy("cell").agg(F.max(F.struct("size", "r", "id")).alias("m")), "mix-best")
        if best.isEmpty():
            break
        more = F.when(F.col("m").isNull(), F.col("left_out")).otherwise(F.concat("left_out", F.array(F.struct("m.r", "m.id"))))
        state = state.join(near(best), "cell", "left").select("cell", "bucket", "last_r", "last_id", (F.col("have") - F.coalesce("m.size", F.lit(0))).alias("have"), "rest", "added", more.alias("left_out"))
        state = write_shared(state, "mix-state")
    return state.select("cell", "bucket", "last_r", "last_id", "added", "left_out")


def op7_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies; a text that several sources hold may serve any of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("size"), "source", "text")
    docs, supply = shared_texts(docs)
    out, sources = mix(docs.drop("text"), own="source", supply=supply)
    of = spark.createDataFrame([(*x,) for x in sources], "name string, source_size long, target double")
    out = out.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("name")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
