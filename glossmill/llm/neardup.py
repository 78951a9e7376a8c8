"""Near-duplicate detection with a containment ensemble.

Equal texts are one class from the start.  The classes' shingle sets are partitioned by size; in a
partition, the wished containment and the sizes that may meet there give a Jaccard threshold, for which
the banding of MinHash signatures is tuned.  A set is indexed in its own partition and asks the next
one.  Where sizes lie further apart the threshold is too low for bands: a set then asks for a few of its
elements, and larger sets answer with theirs.  Elements of many texts are never asked for: sets that
hold the same ones share a profile, and a set that mostly consists of them is held against profiles.
Candidates' containment is computed exactly from the shingle sets.  Linked classes of similar sizes form
groups; a text within a much larger one is linked to it, but stays on its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_text, fresh, give_back, lean, runs, table, write_shared
from .features import GAP, chunks, prefix_sums, span_hash, spans

HASHES = 240
WIDTH = 3  # words of a shingle
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 31, HASHES) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xD6E8FEB86659FD93)
EDGES = 20_000  # edges that the driver joins
FEW = 64  # sets that may hold an element which is always asked for
FULL = 200  # members of larger buckets meet in blocks of families, not in emitted pairs
LOCAL = 64  # members of a bucket that one task sends on; of more, their edges and one member
MASK = 64 << 20  # bytes of a filter of elements, which tasks read from the shared folder
PAGE = 1 << 16  # bits of a filter that a task sets at once
HOT = 1 << 20  # elements of many texts that are known to every task
TASK = 16 << 20  # bytes of texts whose sets meet in one task
PIECE = 1 << 20  # bytes of texts, or four of these of keys, that a task works on at once: its memory, not its result
_U48 = np.uint64((1 << 48) - 1)


def _wide(part: np.ndarray) -> np.ndarray:
    """Bytes of characters of scripts that are written without spaces: each is a word."""
    out = np.zeros(len(part), bool)
    lead = np.flatnonzero((part >= 0xE0) & (part < 0xF0))
    lead = lead[lead + 2 < len(part)]
    if len(lead):
        c = ((part[lead].astype(np.int64) & 15) << 12) | ((part[lead + 1].astype(np.int64) & 63) << 6) | (part[lead + 2] & 63)
        # Thai to Burmese, Khmer, kana, ideographs and their extensions
        out[lead[((c >= 0x0E00) & (c < 0x10A0)) | ((c >= 0x1780) & (c < 0x1800)) | ((c >= 0x3040) & (c < 0xA000)) | ((c >= 0xF900) & (c < 0xFB00))]] = True
    lead = np.flatnonzero((part >= 0xF0) & (part < 0xF8))
    lead = lead[lead + 3 < len(part)]
    if len(lead):
        out[lead[(part[lead] == 0xF0) & (part[lead + 1] >= 0xA0)]] = True
    return out


def shingles(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set elements, all texts' sets one after the other and sorted; their numbers).

    Elements are 48-bit hashes of three words in a row; a text of one or two words has one element.
    Words end at white space; a character of a script without spaces is a word of its own.
    """
    words, own = [], []
    for part, rows, a, b in chunks(raw, lo, hi):
        inside = ~GAP[part]
        if len(part) and part.max() >= 0xE0 and (lead := _wide(part)).any():
            s, e = _single(part, inside, lead, a, b)
        else:
            s, e = spans(inside, a, b)
        words.append(span_hash(prefix_sums(part), s, e))
        own.append(rows[np.searchsorted(a, s, "right") - 1])
    if not words:
        return np.zeros(0, np.int64), np.zeros(len(lo), np.int64)
    w, k = np.concatenate(words), np.concatenate(own)
    n = np.bincount(k, minlength=len(lo)) if len(k) else np.zeros(len(lo), np.int64)
    first = np.cumsum(n) - n
    inside = np.arange(len(w)) - first[k]
    h = w.copy()
    for d in range(1, WIDTH):
        ok = np.flatnonzero(inside + d < n[k])
        h[ok] = (h[ok] ^ (h[ok] >> np.uint64(29))) * _C + w[ok + d]
    h = (h ^ (h >> np.uint64(32))) * _D
    good = inside < np.maximum(n[k] - WIDTH + 1, 1)
    out, counts = [], np.zeros(len(lo), np.int64)
    k, h = k[good], h[good] >> np.uint64(16)
    # neighbours of at most 65,536 texts fit the free 16 bits
    for a in range(0, len(lo), 65536):
        i, j = np.searchsorted(k, [a, a + 65536])
        key = np.sort(((k[i:j] - a).astype(np.uint64) << np.uint64(48)) | h[i:j])
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        counts[a : a + 65536] = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=min(65536, len(lo) - a))
        out.append((key & _U48).astype(np.int64))
    return np.concatenate(out), counts


def _single(part, inside, lead, lo, hi):
    """Like spans(), but each character that ``lead`` marks is a span of its own."""
    at = np.flatnonzero(lead)
    width = np.where(part[at] >= 0xF0, 4, 3)
    body = np.zeros(len(part) + 1, np.int64)
    np.add.at(body, at, 1)
    np.add.at(body, np.minimum(at + width, len(part)), -1)
    alone = np.cumsum(body[:-1]) > 0
    s, e = spans(inside & ~alone, lo, hi)
    s, e = np.r_[s, at], np.r_[e, np.minimum(at + width, len(part))]
    o = np.argsort(s, kind="stable")
    return s[o], e[o]


def signature(elements: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values (hash, set) of the sets that aren't empty."""
    full = counts[counts > 0]
    x = ((elements.astype(np.uint64) * _C) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum(full) - full
    out = np.empty((hashes, len(full)), np.uint32)
    for k in range(hashes):
        np.minimum.reduceat(x * _A[k] + _B[k], at, out=out[k])
    return out


def partition(n, ratio: float):
    return np.floor(np.log(n) / math.log(1 / ratio) + 1e-9).astype(np.int64)


@lru_cache(1024)
def banding(part: int, query: int, contain: float, ratio: float, recall: float) -> tuple[int, int]:
    """(bands, rows) for sets of partition ``query`` that ask partition ``part``.

    Tuned for the least Jaccard similarity that two sets of these sizes have at the wished containment.
    ValueError if the signatures are too short for it.
    """
    base = 1 / ratio
    edge = lambda p: max(1, math.ceil(base**p - 1e-6))
    low, high, top = edge(query), edge(query + 1) - 1, edge(part + 1) - 1
    s = 1.0
    for q in {low, high, *range(low, min(high, low + 400) + 1)}:
        if q < low:
            continue
        x = min(top, int(q / ratio + 1e-9))
        both = min(q, math.ceil(contain * q - 1e-9))
        if x >= q:
            s = min(s, both / (q + x - both))
    if s >= 1:
        return 1, 3
    for rows in (4, 3, 2, 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - s**rows))
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"{HASHES} hashes don't reach recall {recall} at containment {contain} and ratio {ratio}")


def _plans(p: int, contain: float, ratio: float, recall: float) -> list[tuple[int, int, int]]:
    """(target partition, rows, bands) of the keys of a set of partition p: its own, and those it asks in the next."""
    out = []
    for target in (p, p + 1):
        plans: dict[int, int] = {}  # by rows a band: the plan of fewer bands is part of the other
        for q in (target, target - 1) if target == p else (p,):
            if q >= 0:
                bands, rows = banding(target, q, contain, ratio, recall)
                plans[rows] = max(bands, plans.get(rows, 0))
        out += [(target, rows, bands) for rows, bands in plans.items()]
    return out


def buckets(sig: np.ndarray, sizes: np.ndarray, contain: float, ratio: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, numbers of the sets they belong to)."""
    parts = partition(sizes, ratio)
    todo: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    for p in np.unique(parts).tolist():
        mine = np.flatnonzero(parts == p)
        for target, rows, bands in _plans(p, contain, ratio, recall):
            todo.setdefault(rows, []).append((mine, target, bands))
    keys, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows, asked in todo.items():
        most = max(b for _, _, b in asked)
        base = np.full((most, sig.shape[1]), rows, np.uint64)
        for r in range(rows):
            base = (base ^ (base >> np.uint64(31))) * _C + sig[r : r + most * rows : rows]
        base += (np.arange(most, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]
        for mine, target, bands in asked:
            h = base[:bands, mine] ^ np.uint64((target * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(29))) * _D
            keys.append((h ^ (h >> np.uint64(32))).ravel())
            where.append(np.tile(mine, bands))
    return np.concatenate(keys), np.concatenate(where)


def gather(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """vertex -> least vertex of its component, of few edges."""
    v, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(v))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        np.minimum.at(low, label[x], low[y])
        np.minimum.at(low, label[y], low[x])
        low = low[low]
        if (low == label).all():
            return dict(zip(v.tolist(), v[label].tolist(), strict=True))
        label = low


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """id, group: the least id of each connected component of the edges (a, b).

    In each round a vertex joins its least neighbour and the edges are contracted, so that they shrink
    to nothing; once they are at most EDGES, the driver joins the rest.
    """
    spark = edges.sparkSession
    label = None
    edges = write_shared(edges.select("a", "b").where("a <> b").distinct(), "edges")
    for _ in range(most):
        many = edges.count()
        if many <= EDGES:
            got = edges.toArrow()
            rest = gather(np.asarray(got["a"]), np.asarray(got["b"])) if many else {}
            small = spark.createDataFrame(pa.table({"id": pa.array(list(rest), pa.int64()), "group": pa.array(list(rest.values()), pa.int64())}))
            if label is None:
                return write_shared(small, "labels")
            small = small.select(F.col("id").alias("v"), F.col("group").alias("to"))
            return write_shared(label.join(F.broadcast(small), label["group"] == small["v"], "left").select("id", F.coalesce("to", "group").alias("group")), "labels")
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to"))
        low = write_shared(low, "labels")
        if label is None:
            label = low.select(F.col("v").alias("id"), F.col("to").alias("group"))
        else:
            label = write_shared(label.join(low, label["group"] == low["v"], "left").select("id", F.coalesce("to", "group").alias("group")), "labels")
        left = edges.join(low.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(low.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edges = write_shared(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    raise ValueError("the components didn't settle")


def _once(batches, size: int = PIECE):
    """(h1 of different texts, their Arrow texts, other columns), of batches (h1, text, others): a task yields a text once, as long as it remembers it."""
    seen: set[int] = set()
    for batch in batches:
        h1 = np.asarray(batch.column(0))
        _, lo, hi = as_text(batch.column(1))
        for i, j in ((k, min(k + 10_000, y)) for x, y in runs(lo, hi, size) for k in range(x, y, 10_000)):
            _, first = np.unique(h1[i:j], return_index=True)
            new = i + np.sort(first)
            new = new[[x not in seen for x in h1[new].tolist()]]
            if len(seen) < 500_000:
                seen.update(h1[new].tolist())
            if len(new):
                yield h1[new], *(c.take(pa.array(new)) for c in batch.columns[1:])


def _runs_of(keys: np.ndarray, h1: np.ndarray):
    """(keys, h1) of the keys that several different h1 have, sorted by both, and the bounds of each key's run."""
    o = np.argsort(keys, kind="stable")
    k = keys[o]
    same = np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, bool)
    o = o[same | np.r_[same[1:], False]] if len(k) else o
    k, h = keys[o], h1[o]
    o = np.lexsort((h, k))
    k, h = k[o], h[o]
    new = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])] if len(k) else np.zeros(0, bool)
    k, h = k[new], h[new]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
    return k, h, cut


def _met(rows: DataFrame, many: int, contain: float, ratio: float, recall: float) -> DataFrame:
    """a, b, family: pairs that share a bucket, and, of buckets of more than FULL members, each member with the least.

    Keys travel in blocks by range of keys.  A task sends LOCAL members of a bucket at most: where it
    has more, it emits their edges itself and sends one of them, marked, so that no bucket grows with
    the number of rows, only with that of tasks' blocks.
    """
    parts = 1 << max(4, (many * 150 * 16 // (32 << 20)).bit_length())
    own_bits = np.uint64(parts.bit_length() - 1)
    shift = np.uint64(64) - own_bits

    def pack(keys, where, h1):
        """A row for each part of the keys of the sets ``where`` (numbers in h1), one part at a time."""
        part = (keys >> shift).astype(np.min_scalar_type(parts - 1))
        order = np.argsort(part, kind="stable")
        bound = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
        for p in np.flatnonzero(np.diff(bound)).tolist():
            use = order[bound[p] : bound[p + 1]]
            k, h, marks = keys[use], h1[where[use]], np.zeros(0, np.uint64)
            met, who, cut = _runs_of(k, h)
            n = np.diff(cut)
            hot = np.flatnonzero(n > LOCAL)
            if len(hot):
                lead, big = np.repeat(who[cut[hot]], n[hot]), np.repeat(n > LOCAL, n)
                yield -1, lead.tobytes(), who[big].tobytes(), b""
                marks = met[cut[hot]]
                left = ~np.isin(k, marks)
                k, h = np.r_[k[left], marks], np.r_[h[left], who[cut[hot]]]
            own, place = np.unique(h, return_inverse=True)
            # within a part, the 48 bits below its own tell keys apart; texts are numbered
            k = (k << own_bits) >> np.uint64(16)
            cols = np.empty((len(k), 4), np.uint16)
            cols[:, :3] = np.stack([(k >> np.uint64(c)) & np.uint64(0xFFFF) for c in (0, 16, 32)], 1)
            cols[:, 3] = place
            yield p, cols.tobytes(), own.tobytes(), ((marks << own_bits) >> np.uint64(16)).tobytes()

    def sign(batches):
        ks, ws, hs, held, sets = [], [], [], 0, 0

        def batch_of(rows_):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int32()), *[pa.array([r[c] for r in rows_], pa.binary()) for c in (1, 2, 3)]], ["part", "k", "h", "marks"])

        def out():
            keys, where, h1 = np.concatenate(ks), np.concatenate(ws), np.concatenate(hs)
            for x in (ks, ws, hs):
                x.clear()
            rows_, size = [], 0
            for r in pack(keys, where, h1):
                rows_.append(r)
                size += len(r[1]) + len(r[2])
                if size > 4 * PIECE:
                    yield batch_of(rows_)
                    rows_, size = [], 0
            if rows_:
                yield batch_of(rows_)

        for h1, texts in _once(batches):
            elements, counts = shingles(*as_text(texts))
            full = np.flatnonzero(counts)
            if len(full):
                keys, where = buckets(signature(elements, counts, HASHES), counts[full], contain, ratio, recall)
                # at most 60,000 sets are held
                ks.append(keys), ws.append((where + sets).astype(np.uint16)), hs.append(h1[full])
                held, sets = held + len(keys), sets + len(full)
            if held > 1 << 21 or sets > 50_000:
                yield from out()
                held, sets = 0, 0
        if held:
            yield from out()

    def edges(got):
        a, b = (np.concatenate([np.frombuffer(g[c], np.int64) for g in got]) for c in (0, 1))
        return a, b, np.ones(len(a), bool)

    def pairs(keys, h1, marks):
        k, h, cut = _runs_of(keys, h1)
        n = np.diff(cut)
        big = (n > FULL) | np.isin(k[cut[:-1]], marks)
        a, b = [np.repeat(h[cut[:-1][big]], n[big])], [h[np.repeat(big, n)]]
        fam = [np.ones(len(a[0]), bool)]
        for m in np.unique(n[~big & (n > 1)]).tolist():
            block = h[cut[:-1][(n == m) & ~big][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            x, y = block[:, i].ravel(), block[:, j].ravel()
            o = np.lexsort((y, x))
            x, y = x[o], y[o]
            new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            a.append(x[new]), b.append(y[new]), fam.append(np.zeros(int(new.sum()), bool))
        return np.concatenate(a), np.concatenate(b), np.concatenate(fam)

    def meet(batches):
        now, got = None, []

        def batch_of(a, b, fam):
            use = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(b[use]), pa.array(fam[use])], ["a", "b", "family"])

        def out():
            if now < 0:
                yield batch_of(*edges(got))
                return
            cols = [np.frombuffer(g[0], np.uint16).reshape(-1, 4) for g in got]
            own = [np.frombuffer(g[1], np.int64) for g in got]
            marks = np.unique(np.concatenate([np.frombuffer(g[2], np.uint64) for g in got]))
            # a range of keys at a time, by the highest of their bits
            bits = min(16, max(0, (sum(map(len, cols)) * 8 // (4 * PIECE)).bit_length()))
            for s in range(1 << bits):
                use = [c[c[:, 2] >> np.uint16(16 - bits) == s] if bits else c for c in cols]
                h1 = np.concatenate([o[c[:, 3]] for o, c in zip(own, use, strict=True)])
                keys = np.concatenate([c[:, 0].astype(np.uint64) | (c[:, 1].astype(np.uint64) << np.uint64(16)) | (c[:, 2].astype(np.uint64) << np.uint64(32)) for c in use])
                yield batch_of(*pairs(keys, h1, marks))

        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                if got and (p != now or p < 0 and len(got) >= 64):
                    yield from out()
                    got = []
                now = p
                got.append([batch.column(c)[i].as_buffer() for c in (1, 2, 3)])
        if got:
            yield from out()

    signed = rows.mapInArrow(lean(sign), "part int, k binary, h binary, marks binary")
    spread = F.when(F.col("part") < 0, F.xxhash64("h")).otherwise(F.col("part"))
    tasks = max(parts // 4, 16)
    return signed.repartition(tasks, spread).sortWithinPartitions("part").mapInArrow(lean(meet), "a long, b long, family boolean").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", contain: float = 0.7, ratio: float = 0.7, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: the key, text_id (least id with an equal text), class_id (least id of the group; groups
    are formed by links of sets whose sizes differ by ``ratio`` at most), copies (rows of this text) and
    n_links (different texts it is linked to).  links: a, b (text ids), containment; the links by
    profile are expanded in it, which n_links never needs.  Two texts are linked if the containment of
    the smaller shingle set in the larger one is at least ``contain``, whatever their sizes; the search
    finds each such pair with a probability of at least ``recall``, in large families as in small ones.
    Null texts are one class of their own, as empty ones are; neither has links.  A text whose rows all
    have null ids is known by a negative hash of it (strings: by that number).  Ids may be of any
    ordered type; different texts that share an id stay different texts.  Other columns aren't looked at.
    """
    found, classes, links, quoted = _search(docs, text, key, contain, ratio, recall)
    of = lambda h, x: classes.select(F.col("h1").alias(h), F.col("id").alias(x))
    every = links.unionByName(quoted)
    every = every.join(of("a", "_i"), "a").join(of("b", "_j"), "b").select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), "containment")
    # salted: one text may be that of many rows
    salts = 16
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    ids = docs.select(F.col(key), F.xxhash64(text).alias("h1"), salt(F.col(key).cast(found.schema["real"].dataType)).alias("salt"))
    every_salt = F.when(F.col("copies") == 1, F.array(salt("real"))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    out = ids.join(found.withColumn("salt", F.explode(every_salt)), ["h1", "salt"])
    return out.select(key, "text_id", "class_id", "copies", "n_links"), every


def _search(docs: DataFrame, text: str, key: str, contain: float, ratio: float, recall: float, count: bool = True):
    """(found: h1, text_id, real (null where all ids are), class_id, copies, n_links, group), (classes: h1, id, real, copies, size), links, links by profile.

    The latter two are by h1.  Without ``count``, only what groups need: links of similar sizes.
    """
    kind = "long" if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    hashes = docs.select(F.col(key).cast(kind).alias("id"), F.xxhash64(text).alias("h1"), F.octet_length(text).alias("size"))
    none = (-F.shiftrightunsigned("h1", 1) - 1).cast(kind)
    classes = hashes.groupBy("h1").agg(F.min("id").alias("real"), F.count(F.lit(1)).alias("copies"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("size"))
    classes = write_shared(classes.withColumn("id", F.coalesce("real", none)), "classes")
    many = classes.count()
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h1"), F.lower(text).alias("t"))
    met = write_shared(_met(rows, many, contain, ratio, recall), "met")
    sizes = classes.select("h1", "size")
    family = components(met.where("family"))
    end = lambda x: family.select(F.col("id").alias(x), F.col("group").alias(f"_{x}"))
    apart = ~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    pairs = met.where("not family").select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left").where(apart).select("a", "b")
    links = write_shared(verify(rows, sizes, pairs, contain, ratio).unionByName(_within(rows, sizes, family, contain, ratio)), "links")
    quoted = None
    counts = links.select(F.col("a").alias("h1"), F.lit(0).cast("long").alias("n")).limit(0)
    group = components(links)
    if count:
        far, counts, quoted = _unlike(rows, sizes, many, contain, ratio, recall)
        links = links.unionByName(far)
    label = classes.select("h1", "id").join(group.select(F.col("id").alias("h1"), "group"), "h1")
    least = label.groupBy("group").agg(F.min("id").alias("class_id"))
    ends = links.select(F.col("a").alias("h1")).union(links.select("b")).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
    ends = ends.unionByName(counts).groupBy("h1").agg(F.sum("n").alias("n_links"))
    grouped = label.join(least, "group").select("h1", "group", "class_id")
    found = classes.join(ends, "h1", "left").join(grouped, "h1", "left").select("h1", F.col("id").alias("text_id"), "real", F.coalesce("class_id", "id").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "h1").alias("group"))
    return found, classes, links, quoted


def _unlike(rows: DataFrame, sizes: DataFrame, many: int, contain: float, ratio: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links of sizes further apart than ``ratio``, (h1, n: number of those by profile alone), these, expanded)."""
    hot = _hot(rows, many)
    asked = write_shared(_asked(rows, hot, contain, recall), "asked")
    met = write_shared(_far(rows, asked, ratio), "far-pairs")
    counts, quoted, has, shared = _profiles(asked, ratio, contain)
    far = _verify_far(rows, sizes, met.where("need > 0").select("small", "large"), contain)
    return far.unionByName(_mostly_hot(met.where("need = 0"), has, shared, contain)), counts, quoted


def _place(family: DataFrame, sizes: DataFrame, most: int):
    """(id, group, blocks of the group, own block; the task in which two blocks of a group meet).

    A block holds ``most`` sets or TASK / 2 bytes of text at most, or one set.
    """
    family = family.join(sizes.select(F.col("h1").alias("id"), "size"), "id")
    total = family.groupBy("group").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("bytes"))
    weight = family.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, -(-weight[0] // TASK), -(-weight[1] // (4 * most)))
    blocks = F.greatest(F.ceil(F.col("many") / most), F.ceil(F.col("bytes") / (TASK // 2)), F.lit(1)).cast("int")
    placed = family.join(total, "group").select("id", "group", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    # a family of one block goes to a common task; tasks of larger families are known by negative numbers
    task = lambda i, j: F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(tasks))).otherwise(-1 - F.pmod(F.xxhash64("group", i, j), F.lit(1 << 62)))
    return write_shared(placed, "families"), task


def _sets(rows: DataFrame, where: DataFrame, files: Sequence[str] = (), pages: int = 0) -> DataFrame:
    """The rows of ``where`` (id and others) with the shingle sets of the texts whose hashes are the ids, of what the filter lets through.

    The others are known before the sets are made, so that these are sent only once, to where they are compared.
    A filter in the shared folder keeps back the texts that nobody asks for; the rest is joined by shuffles, as the
    number of those that are asked for, and of the places of one, grows with the input.
    """

    def sets(batches):
        mask = _mask(files, pages)
        for h1, texts, to in _once(batches):
            elements, counts = shingles(*as_text(texts))
            if pages:
                at = _passing(mask, elements)
                elements, counts = elements[at], np.bincount(np.repeat(np.arange(len(counts)), counts)[at], minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(elements)), to], ["id", "set", "to"])

    places = where.groupBy(F.col("id").alias("h1")).agg(F.collect_set(F.struct(*[c for c in where.columns if c != "id"])).alias("to"))
    places = write_shared(places, "places")
    wanted, width = _write_mask(places.select(F.col("h1").bitwiseAND(int(_U48)).alias("element")), "places-mask")

    def texts(batches):
        mask = _mask(wanted, width)
        asked = (b.take(pa.array(_passing(mask, np.asarray(b.column(0)) & np.int64(_U48)))) for b in batches)
        for h1, t in _once(asked):
            yield pa.RecordBatch.from_arrays([pa.array(h1), t], ["h1", "t"])

    some = rows.select("h1", "t").mapInArrow(lean(texts), "h1 long, t string").join(places, "h1").select("h1", "t", "to")
    return some.mapInArrow(lean(sets), f"id long, set array<long>, to {some.schema['to'].dataType.simpleString()}").select("id", "set", F.inline("to"))


def _held(sets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, elements one set after the other, bounds); a set that came twice is there twice."""
    col = sets["set"].combine_chunks()
    return np.asarray(sets["id"]), np.asarray(col.flatten()), np.r_[0, np.cumsum(np.asarray(pc.list_value_length(col)))].astype(np.int64)


def _views(sets: pa.Table) -> dict[int, np.ndarray]:
    """The sets by id, where they lie."""
    out = {}
    for part in sets.select(["id", "set"]).to_batches():
        flat, off = np.asarray(part["set"].flatten()), np.r_[0, np.cumsum(np.asarray(pc.list_value_length(part["set"])))].tolist()
        out.update((k, flat[i:j]) for k, i, j in zip(part["id"].to_pylist(), off, off[1:], strict=False))
    return out


def _compare(contain: float, ratio: float | None):
    """Links of the asked pairs, of sizes at most ``ratio`` apart; without it, of a whole set and what another one may share with it."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = _views(left)
        a, b = np.asarray(right["a"]), np.asarray(right["b"])
        c = np.zeros(len(a))
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            u, v = sets[x], sets[y]
            if ratio is not None and len(u) > len(v):
                u, v = v, u
            if ratio is not None and len(u) < ratio * len(v) or not len(v):
                continue
            shared = u[v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u]
            if len(shared) >= contain * len(u) - 1e-9:
                c[k] = len(shared) / len(u)
        ok = c > 0
        del sets
        give_back()
        return pa.table({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "containment": c[ok]})

    return compare


LINK = "a long, b long, containment double"


def verify(rows: DataFrame, sizes: DataFrame, pairs: DataFrame, contain: float, ratio: float) -> DataFrame:
    """The pairs (of similar sizes) whose exact containment is at least ``contain``.

    Pairs meet in the families that they form.  Families share tasks; a larger family is cut into
    blocks, and every two of its blocks meet.  So a set travels once, or once for each block of its
    family in which it has a pair, and not once for each pair.
    """
    pairs = write_shared(pairs, "pairs")
    placed, task = _place(components(pairs), sizes, 1000)
    end = lambda x: placed.select(F.col("id").alias(x), "group", "blocks", F.col("own").alias(f"_{x}"))
    asked = pairs.join(end("a"), "a").join(end("b").drop("group", "blocks"), "b").select("a", "b", task(F.least("_a", "_b"), F.greatest("_a", "_b")).alias("task"))
    asked = write_shared(asked, "asked-pairs")
    where = asked.select(F.col("a").alias("id"), "task").union(asked.select("b", "task")).distinct()
    sent = _sets(rows, where).select("task", "id", "set")
    return sent.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(_compare(contain, ratio), LINK)


def _verify_far(rows: DataFrame, sizes: DataFrame, pairs: DataFrame, contain: float) -> DataFrame:
    """Links of pairs of a small set, whose hot elements alone don't suffice, and a larger one.

    Pairs meet by larger set; those of one that many ask are spread over several tasks.  Small sets travel
    as they are, and larger ones without what no small set has.
    """
    size = lambda x: sizes.select(F.col("h1").alias(x), F.col("size").alias(f"_{x}"))
    pairs = write_shared(pairs.join(size("small"), "small").join(size("large"), "large"), "far-sizes")
    per = pairs.groupBy("large").agg((F.sum("_small") + F.max("_large")).alias("bytes"))
    total = per.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK))
    salts = F.ceil(F.col("bytes") / TASK).cast("int")
    asked = pairs.join(per, "large").withColumn("task", F.pmod(F.xxhash64("large", F.pmod(F.xxhash64("small"), salts)), F.lit(tasks)))
    where = asked.select(F.col("small").alias("id"), "task").union(asked.select("large", "task")).distinct()
    asked = asked.select(F.col("small").alias("a"), F.col("large").alias("b"), "task")
    small = _sets(rows, pairs.select(F.col("small").alias("id"), F.lit(0).alias("task")))
    files, pages = _write_mask(write_shared(small.select(F.explode("set").alias("element")), "small-elements"), "small-mask")
    sent = _sets(rows, where, files, pages).select("task", "id", "set")
    return write_shared(sent.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(_compare(contain, None), LINK), "far-links")


def _hot(rows: DataFrame, many: int, sample: int = 5000, least: int = 10) -> np.ndarray:
    """Elements of at least ``least`` of about ``sample`` texts (of all, if fewer), sorted; HOT at most, the most frequent first.

    They only decide by which way a pair is found.
    """

    def elements(batches):
        for _, texts in _once(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(*as_text(texts))[0])], ["element"])

    part = rows.where(F.pmod(F.xxhash64("h1", F.lit("hot")), F.lit(max(1, many // sample))) == 0).dropDuplicates(["h1"])
    often = part.mapInArrow(lean(elements), "element long").groupBy("element").count().where(F.col("count") >= least)
    got = often.orderBy(F.desc("count"), "element").limit(HOT).select("element").toArrow()
    return np.sort(np.asarray(got["element"]).astype(np.int64))


@lru_cache(4096)
def sure_hits(draws: int, share64: int, recall: float) -> int:
    """How many of ``draws`` elements are hit with a probability of at least ``recall``, if share64 / 64 of all are there; 1 at least."""
    p = share64 / 64
    if p >= 1:
        return draws
    k = np.arange(draws + 1)
    log = np.r_[0.0, np.cumsum(np.log(np.arange(1, draws + 1)))]
    tail = np.cumsum(np.exp(log[draws] - log[k] - log[draws - k] + k * math.log(p) + (draws - k) * math.log1p(-p)))
    return max(1, int(np.searchsorted(tail, 1 - recall, "right")))


def asks(elements: np.ndarray, counts: np.ndarray, hot: np.ndarray, contain: float, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(elements that the sets ask for, how many each asks for and how many of these must be hit, which elements are hot, which sets are heavy).

    A set is heavy if its hot elements alone can be ``contain`` of it.  Another set asks for elements
    that aren't hot; a set that holds ``contain`` of it has the hits that must be with a probability of
    at least ``recall``, whatever hot elements it holds.  A heavy set asks for all that aren't hot, for
    what the hot ones don't find.
    """
    n = len(counts)
    own = np.repeat(np.arange(n), counts)
    common = hot[np.minimum(np.searchsorted(hot, elements), len(hot) - 1)] == elements if len(hot) else np.zeros(len(elements), bool)
    warm = np.bincount(own[common], minlength=n)
    rare = counts - warm
    least = np.ceil(contain * counts - 1e-9).astype(np.int64) - warm  # of its rare elements that must be in the other set
    heavy = (least < 1) & (counts > 0)
    share = np.where(rare > 0, 64 * np.maximum(least, 0) // np.maximum(rare, 1), 0)
    one = np.ceil(math.log(1 - recall) / np.log1p(-np.clip(least / np.maximum(rare, 1), 1e-9, 1 - 1e-12)))
    want = np.where(heavy, rare, np.minimum(np.where(share > 0, 4 * one, one), rare)).astype(np.int64)
    must = np.where(heavy, 1, np.where(want == rare, least, 1))
    for k in np.flatnonzero(~heavy & (want < rare) & (share > 0)).tolist():
        must[k] = sure_hits(int(want[k]), int(share[k]), recall)
    order = (elements.astype(np.uint64) * _D) & _U48  # its 48 bits differ for different elements
    # those in the first part of the order are enough for most sets
    near = np.minimum(1.0, (2 * want + 16) / np.maximum(rare, 1)) * float(1 << 48)
    some = ~common & (order < near[own])
    short = np.bincount(own[some], minlength=n) < want
    if short.any():
        some |= ~common & short[own]
    at = np.flatnonzero(some)
    o = at[np.lexsort((order[at], own[at]))]
    have = np.bincount(own[o], minlength=n)
    rank = np.arange(len(o)) - (np.cumsum(have) - have)[own[o]]
    use = o[rank < want[own[o]]]
    return elements[use], np.bincount(own[use], minlength=n), must, common, heavy


def _asked(rows: DataFrame, hot: np.ndarray, contain: float, recall: float) -> DataFrame:
    """kind, h1, n, p, element.

    0: an element that a set asks for; p is the number of hits that must be, 0 if it is heavy.  1: a set of n elements with the profile p of its hot ones; element is their number, negative unless it is heavy.
    2: an element of profile p.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        known: set[int] = set()
        for h1, texts in _once(batches):
            elements, counts = shingles(*as_text(texts))
            e, m, must, common, heavy = asks(elements, counts, shared.value, contain, recall)
            own = np.repeat(np.arange(len(counts)), counts)
            a = np.repeat(np.arange(len(counts)), m)
            out = [(np.zeros(len(e), np.int8), h1[a], counts[a], np.where(heavy, 0, must)[a], e)]
            mine, hers = own[common], elements[common]
            if len(mine):
                mixed = (hers.astype(np.uint64) ^ (hers.astype(np.uint64) >> np.uint64(23))) * _C
                mixed = (mixed ^ (mixed >> np.uint64(31))) * _D
                has = np.unique(mine)
                p = np.add.reduceat(mixed, np.searchsorted(mine, has)).view(np.int64)
                out.append((np.ones(len(has), np.int8), h1[has], counts[has], p, np.where(heavy, 1, -1)[has] * np.diff(np.r_[np.searchsorted(mine, has), len(mine)])))
                new = np.zeros(len(counts), bool)
                for k, x in zip(has.tolist(), p.tolist(), strict=True):
                    if x not in known:
                        new[k] = True
                        if len(known) < 500_000:
                            known.add(x)
                pick = new[mine]
                of = np.zeros(len(counts), np.int64)
                of[has] = p
                out.append((np.full(int(pick.sum()), 2, np.int8), np.zeros(int(pick.sum()), np.int64), np.zeros(int(pick.sum()), np.int64), of[mine[pick]], hers[pick]))
            kind, h, n, p, e = (np.concatenate([x[c] for x in out]) for c in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h), pa.array(n.astype(np.int32)), pa.array(p), pa.array(e)], ["kind", "h1", "n", "p", "element"])

    return rows.mapInArrow(lean(run), "kind byte, h1 long, n int, p long, element long")


def _spot(elements: np.ndarray, k: int) -> np.ndarray:
    """The k-th of an element's three bits, which lie in one page."""
    e = elements.astype(np.uint64)
    return ((((e ^ (e >> np.uint64(17))) * (_C, _D, np.uint64(0xC2B2AE3D27D4EB4F))[k]) >> np.uint64(40)) % np.uint64(PAGE)).astype(np.int64)


def _write_mask(elements: DataFrame, label: str) -> tuple[list[str], int]:
    """(files, pages) of a filter of the elements, of 16 bits for each or MASK bytes; (none, 0) where that leaves fewer than 2 bits."""
    many = elements.count()
    if 2 * many > 8 * MASK:
        return [], 0
    pages = max(1, min(-(-16 * many // PAGE), 8 * MASK // PAGE))

    def fill(group: pa.Table) -> pa.Table:
        x, e = np.zeros(PAGE, bool), np.asarray(group["element"])
        for k in range(3):
            x[_spot(e, k)] = True
        return pa.table({"page": group["page"].slice(0, 1), "bits": pa.array([np.packbits(x).tobytes()], pa.binary())})

    filled = elements.select((F.col("element") % pages).alias("page"), "element").groupBy("page").applyInArrow(fill, "page long, bits binary")
    return write_shared(filled, label).inputFiles(), pages


def _mask(files: Sequence[str], pages: int) -> np.ndarray:
    """The bits of the pages that the Parquet files hold."""
    out = np.zeros(pages * PAGE // 8, np.uint8)
    for f in files:
        t = pq.read_table(f, columns=["page", "bits"])
        for k, bits in zip(t["page"].to_pylist(), t["bits"], strict=True):
            out[k * PAGE // 8 : (k + 1) * PAGE // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def _passing(mask: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Where the elements are that a filter lets through: all, if it has no pages."""
    at = np.arange(len(elements))
    for k in range(3 if len(mask) else 0):
        x = elements[at] % (len(mask) * 8 // PAGE) * PAGE + _spot(elements[at], k)
        at = at[(mask[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1]
    return at


def _far(rows: DataFrame, asked: DataFrame, ratio: float) -> DataFrame:
    """small, n, large, need, hits: candidates of sizes further apart than ``ratio``; need is 0 where the small set is heavy.

    A filter of all that is asked for keeps back most elements of the sets that answer, as long as MASK
    bytes suffice; beyond that all elements go to the join.  It lies in the shared folder: the driver
    never holds it.  A set that must have m hits has m - k of them without any k < m of its elements: as
    many of those that more than FEW sets hold, the commonest first, are left out, so that these don't
    pair all their sets.
    """
    asked = asked.where("kind = 0").select("h1", "n", F.col("p").alias("must"), "element")
    files, pages = _write_mask(asked.select("element"), "asked-mask")

    def answer(batches):
        mask = _mask(files, pages)
        for h1, texts in _once(batches):
            elements, counts = shingles(*as_text(texts))
            at = _passing(mask, elements)
            own = np.repeat(np.arange(len(counts)), counts)[at]
            yield pa.RecordBatch.from_arrays([pa.array(h1[own]), pa.array(counts[own].astype(np.int32)), pa.array(elements[at])], ["h1", "n", "element"])

    held = rows.mapInArrow(lean(answer), "h1 long, n int, element long")
    both = asked.unionByName(held, allowMissingColumns=True)
    holds, one = F.col("must").isNull(), Window.partitionBy("element")
    both = both.withColumns({"many": F.count(F.when(holds, 1)).over(one), "most": F.max(F.when(holds, F.col("n"))).over(one), "least": F.min(F.when(~holds, F.col("n"))).over(one)})
    both = both.where(F.when(holds, F.col("least") < ratio * F.col("n")).otherwise(F.col("n") < ratio * F.col("most")))
    both = write_shared(both.select("h1", "n", "must", "element", "many"), "elements-met")
    own = Window.partitionBy("h1")
    out = (F.col("many") > FEW) & (F.row_number().over(own.orderBy(F.desc("many"), "element")) < F.col("must"))
    asks = both.where(~holds).repartition("h1").dropDuplicates(["h1", "element"]).withColumns({"have": F.count(F.lit(1)).over(own), "out": out}).where("have >= must")
    asks = asks.withColumn("need", F.col("must") - F.count(F.when(F.col("out"), 1)).over(own)).where("not out").select(F.col("h1").alias("small"), "n", "need", "element")
    met = asks.join(both.where(holds).select(F.col("h1").alias("large"), F.col("n").alias("nl"), "element"), "element").where(F.col("n") < ratio * F.col("nl"))
    return met.groupBy("small", "n", "large", "need").agg(F.count_distinct("element").alias("hits")).where("hits >= need")


def _profiles(asked: DataFrame, ratio: float, contain: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(h1, n: number of links by profile alone), (these links, expanded), (h1, n, p, heavy), (ps, p, shared: elements of both, where they are enough for a heavy set of ps to be in a set of p).

    Sets of one profile and size are counted together: a heavy set of n elements is linked to all sets
    of more than n / ratio elements whose profile shares ``contain`` of n with its own.
    """
    has = asked.where("kind = 1").groupBy("h1").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.first("element").alias("hot"))
    has = write_shared(has.select("h1", "n", "p", (F.col("hot") > 0).cast("int").alias("heavy"), F.abs("hot").alias("hot")), "profiled")
    heavy = has.where("heavy = 1").groupBy("p", "n").agg(F.count(F.lit(1)).alias("k"))
    sets = asked.where("kind = 2").select("p", "element").distinct()
    # only elements of which a larger set has one that a heavy set asks for, and only in such sets
    n_heavy = F.when(F.col("heavy") == 1, F.col("n"))
    # a heavy set of n elements, of which n - hot are not hot, must share contain * n - (n - hot) hot ones, however it is found
    bound = F.ceil(F.max("hot") - (1 - contain) * F.max(n_heavy) - 1e-6).cast("int")
    sizes = has.groupBy("p").agg(F.min(n_heavy).alias("least"), F.max("n").alias("most"), F.max("hot").alias("hot"), bound.alias("bound"))
    sets = write_shared(sets.join(sizes, "p"), "profile-elements")
    reach = sets.groupBy("element").agg(F.min("least").alias("mn"), F.max("most").alias("mx")).where(F.col("mn") < ratio * F.col("mx"))
    sets = sets.join(reach.hint("shuffle_hash"), "element")
    ask = sets.where(F.col("least") < ratio * F.col("mx")).select("element", F.col("p").alias("ps"), "least", "bound")
    sets = sets.where(ratio * F.col("most") > F.col("mn")).select("element", "p", "most", "hot")
    both = sets.join(ask.hint("merge"), "element").where((F.col("least") < ratio * F.col("most")) & (F.col("hot") >= F.col("bound")))
    both = both.groupBy("ps", "p").agg(F.count(F.lit(1)).alias("shared"), F.first("bound").alias("bound")).where("shared >= bound")
    both = write_shared(both.select("ps", "p", "shared"), "profile-pairs")
    # equal profiles need no comparison, but are compared all the same
    enough = F.col("shared") >= F.ceil(contain * F.col("n") - 1e-9)
    ok = write_shared(heavy.withColumnRenamed("p", "ps").join(both, "ps").where(enough).select("ps", "n", "p", "k"), "profile-links")
    larger = has.groupBy("p", "n").agg(F.count(F.lit(1)).alias("k"))
    # in one order by size: an asking set is at n, an answering one at ratio * n
    line = ok.select("p", F.col("n").cast("double").alias("x"), F.lit(0).alias("kind"), "ps", "n", "k").unionByName(
        larger.join(ok.select("p").distinct(), "p", "left_semi").select("p", (ratio * F.col("n")).alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ps"), "n", "k")
    )
    w = Window.partitionBy("p").orderBy(F.desc("x"), "kind", "ps", "n")
    above = F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("k"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("k"))).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    told = line.withColumn("links", F.when(F.col("kind") == 0, above).otherwise(below)).where("links > 0")
    told = write_shared(told.select("kind", "ps", "p", "n", "links"), "profile-counts")
    as_small = told.where("kind = 0").groupBy(F.col("ps").alias("p"), "n").agg(F.sum("links").alias("links"))
    small_n = has.where("heavy = 1").join(as_small, ["p", "n"]).select("h1", F.col("links").alias("n"))
    large_n = has.join(told.where("kind = 1").select("p", "n", "links"), ["p", "n"]).select("h1", F.col("links").alias("n"))
    left = has.where("heavy = 1").select(F.col("h1").alias("a"), F.col("n").alias("na"), F.col("p").alias("ps"))
    right = has.select(F.col("h1").alias("b"), F.col("n").alias("nb"), "p")
    pairs = left.join(ok.select("ps", F.col("n").alias("na"), "p").join(both, ["ps", "p"]), ["ps", "na"]).join(right, "p").where(F.col("na") < ratio * F.col("nb"))
    quoted = pairs.select("a", "b", (F.col("shared") / F.col("na")).alias("containment"))
    return small_n.unionByName(large_n), quoted, has, both


def _mostly_hot(met: DataFrame, has: DataFrame, shared: DataFrame, contain: float) -> DataFrame:
    """Links of heavy sets, less those that the profiles hold: of pairs (small, n, large, hits), where all that isn't hot was asked for, profiles know the rest."""
    of = lambda h, p: has.select(F.col("h1").alias(h), F.col("p").alias(p))
    met = met.join(of("small", "ps"), "small").join(of("large", "p"), "large", "left").join(shared, ["ps", "p"], "left")
    warm = F.coalesce("shared", F.lit(0))
    met = met.where((warm + F.col("hits") >= contain * F.col("n") - 1e-9) & (warm < F.ceil(contain * F.col("n") - 1e-9)))
    return met.select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"), ((warm + F.col("hits")) / F.col("n")).alias("containment"))


def overlaps(elements: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many elements each two of the sets ``left`` and ``right`` share, a set and itself aside (sets are numbers in ``own``)."""
    place = [np.full(int(max(own.max(initial=0), left.max(initial=0), right.max(initial=0))) + 1, -1) for _ in range(2)]
    for at, sets in zip(place, (left, right), strict=True):
        at[sets] = np.arange(len(sets))
    use = (place[0][own] >= 0) | (place[1][own] >= 0)
    _, column, often = np.unique(elements[use], return_inverse=True, return_counts=True)
    own, shared = own[use], often > 1
    use = shared[column]
    column, own = (np.cumsum(shared) - 1)[column[use]], own[use]
    o = np.argsort(column, kind="stable")
    column, own = column[o], own[o]
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24
    for c in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [c, c + width])
        half = []
        for at, sets in zip(place, (left, right), strict=True):
            x = np.zeros((len(sets), width), np.float32)
            k = at[own[i:j]]
            x[k[k >= 0], column[i:j][k >= 0] - c] = 1
            half.append(x)
        out += half[0] @ half[1].T
    return out.astype(np.int64)


def _within(rows: DataFrame, sizes: DataFrame, family: DataFrame, contain: float, ratio: float) -> DataFrame:
    """Links of any two members of a family: every pair is compared, in each two blocks of the family."""
    placed, task = _place(family, sizes, 500)
    where = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    where = where.select("id", "group", "own", task(F.least("own", "other"), F.greatest("own", "other")).alias("task"))

    def compare(sets: pa.Table) -> pa.Table:
        sets = sets.combine_chunks()
        ids, first = np.unique(np.asarray(sets["id"]), return_index=True)
        sets = sets.take(pa.array(first)).combine_chunks()
        _, elements, off = _held(sets)
        counts = np.diff(off)
        own = np.repeat(np.arange(len(ids)), counts)
        groups, blocks = np.asarray(sets["group"]), np.asarray(sets["own"])
        a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for g in np.unique(groups).tolist():
            mine = np.flatnonzero(groups == g)
            halves = [mine[blocks[mine] == x] for x in np.unique(blocks[mine])]
            left, right = halves[0], halves[-1]
            less = np.minimum(counts[left][:, None], counts[right][None, :])
            more = np.maximum(counts[left][:, None], counts[right][None, :])
            shared = overlaps(elements, own, left, right)
            ok = (shared >= contain * less - 1e-9) & (less >= ratio * more)
            if len(halves) == 1:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            x, y = ids[left[i]], ids[right[j]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            c.append((shared / less)[i, j])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "containment": np.concatenate(c)})

    sent = _sets(rows, where).select("task", "id", "group", "own", "set")
    return sent.groupBy("task").applyInArrow(compare, LINK)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", contain: float = 0.7, ratio: float = 0.7, recall: float = 0.99) -> DataFrame:
    """docs with one row of each group of near_duplicates(): that of the least id (a null id comes last).

    Rows that are equal in id and text are interchangeable.  All columns are kept as they are.
    """
    found = _search(docs, text, key, contain, ratio, recall, count=False)[0]
    h, real, group = (fresh(docs.columns, x) for x in ("_h", "_real", "_group"))
    first = found.groupBy(F.col("group").alias(group)).agg(F.min(F.struct("text_id", "h1", "real")).alias("m")).select(F.col("m.h1").alias(f"{h}1"), F.col("m.real").alias(real))
    some = docs.withColumn(h, F.xxhash64(text))
    return some.join(first, (F.col(h) == F.col(f"{h}1")) & F.col(key).cast(found.schema["real"].dataType).eqNullSafe(F.col(real)), "left_semi").dropDuplicates([h]).drop(h)


def op9_containment_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text_id, class_id, copies, n_links; see near_duplicates()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs)[0]
