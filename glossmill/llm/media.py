"""Media columns: payloads as lossless WebP images and back.

A payload's bytes are the green samples of opaque pixels, 576 a row; payloads of more than 16,384 rows
become several files, one after the other.  An image takes the shortest of a few prefix codes made for
kinds of text, so that a batch of images is written, and read again, with array arithmetic; the padding
at the end is a back-reference.  Images that repeat themselves, or of few different samples, are
written with codes of their own, back-references, and a colour cache or a palette, if that is shorter.
These, and images of any other making, are read by the scalar decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .common import as_text, table

ROW = 576
FRAME = ROW * webp.MAX_SIDE
_SLICE = 1 << 20
FEW = 96  # so many images are read one by one


def _weights() -> list[list[int]]:
    """How often each byte occurs in kinds of text: Latin, Cyrillic, ideographs, other scripts, any bytes."""
    latin = [3] * 256
    for c, w in zip(b" etainosrhldcumfpgwybvk,.\n", (1800, 1250, 930, 800, 800, 760, 750, 650, 650, 500, 430, 400, 330, 300, 260, 230, 200, 190, 170, 160, 150, 100, 80, 90, 110, 60), strict=True):
        latin[c] += w
    for c in range(65, 91):
        latin[c] += 8
    for c in b"0123456789!|#$%&*'\"-jxqz":
        latin[c] += 12
    for c in (0xC3, 0xE2, 0x80, 0xA9, 0xA8, 0xA4, 0xB6, 0xBC, 0xB1, 0xAD, 0xB3, 0xAA, 0xA1, 0xA7):
        latin[c] += 40
    latin[0xC3] += 160
    latin[255] += 20

    def other(tail: int, lead: dict[int, int], marks: dict[int, int]) -> list[int]:
        out = [2] * 256
        for c in range(0x80, 0xC0):
            out[c] = tail
        for c, w in {32: 300, 10: 30, 44: 30, 46: 30, **lead, **marks}.items():
            out[c] = w
        return out

    second = (0xBE, 900, 0xB5, 750, 0xB0, 700, 0xB8, 650, 0xBD, 600, 0x82, 550, 0x81, 480, 0x80, 420, 0xB2, 400, 0xBB, 390, 0xBA, 310, 0xBC, 290, 0xB4, 270, 0xBF, 250, 0x83, 230, 0x8F, 180, 0x8B, 170, 0x8C, 160)
    cyrillic = other(60, {0xD0: 2600, 0xD1: 1700, 0xCE: 60, 0xCF: 40, 32: 1400}, dict(zip(second[::2], second[1::2], strict=True)))
    ideographs = other(165, {0xE3: 700, 0xE4: 900, 0xE5: 1000, 0xE6: 900, 0xE7: 800, 0xE8: 700, 0xE9: 600, 0xEF: 200, 32: 20, 10: 20}, {0x80: 330, 0x81: 330, 0x82: 300, 0xBC: 250})
    scripts = other(120, {0xD7: 500, 0xD8: 700, 0xD9: 600, 0xE0: 1500, 0xEA: 200, 0xEB: 200, 0xEC: 300, 0xED: 100, 32: 500}, {0xA4: 500, 0xA5: 400, 0xB8: 500, 0xB9: 300})
    return [[*x, *[2] * 24] for x in (latin, cyrillic, ideographs, scripts)] + [[100] * 256 + [1] * 24]


KINDS = 5


@lru_cache(KINDS)
def _fixed(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code and bits of each symbol of the green alphabet, header words, header bits)."""
    lengths = webp.huffman(_weights()[kind])
    codes = webp.canonical(lengths)
    out = webp.Writer()
    out.write(0, 1)  # no transform
    out.write(0, 1)  # no colour cache
    out.write(0, 1)  # one group of codes
    webp.write_code(out, lengths)
    for one in (0, 0, 255, 1):  # red, blue, alpha, distance: always the pixel before
        webp.write_code(out, [int(s == one) for s in range(40 if one == 1 else 256)])
    n = 8 * len(out.out) + out.n
    data = out.done()
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), "<u4")
    code = np.array([codes[s][0] for s in range(280)], np.uint64)
    return code, np.array([codes[s][1] for s in range(280)], np.int64), words, n


def _repeats(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which ranges mostly consist of what they held before: of their 8-grams, as far as drawn by hash, at most an eighth differ."""
    size = np.maximum(hi - lo - 7, 0)
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    h = np.zeros(len(at), np.uint32)
    for k in range(8):
        h = h * np.uint32(0x01000193) + raw[at + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    drawn = np.flatnonzero(h >> np.uint32(28) == 0)
    doc = np.repeat(np.arange(len(lo)), size)[drawn]
    both = np.unique(doc.astype(np.uint64) << np.uint64(32) | h[drawn])
    many, different = np.bincount(doc, minlength=len(lo)), np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(lo))
    return (many >= 16) & (8 * different <= many)


def _special(part: np.ndarray, few: bool) -> bytes:
    """The shortest file that the general encoder makes of a payload."""
    full = np.full(max(1, -(-len(part) // ROW)) * ROW, 255, np.uint32)
    full[: len(part)] = part
    argb = (np.uint32(0xFF000000) | full << np.uint32(8)).reshape(-1, ROW)
    return min((webp.encode(argb, **way) for way in ({}, {"cache_bits": 6}, *([{"palette": True}] if few else []))), key=len)


def encode_frames(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """One file for each range lo:hi of raw (of at most FRAME bytes), padded with bytes 255."""
    n = len(lo)
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    hist = np.bincount(np.repeat(np.arange(n), size) * 256 + raw[at], minlength=n * 256).reshape(n, 256)
    bits = hist @ np.stack([_fixed(k)[1][:256] for k in range(KINDS)], 1) + np.array([_fixed(k)[3] for k in range(KINDS)])
    kind = bits.argmin(1)
    out: list[bytes] = [b""] * n
    for k in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == k)
        for x, data in zip(mine.tolist(), _encode(raw, lo[mine], hi[mine], k), strict=True):
            out[x] = data
    few = (hist > 0).sum(1) < 16
    for x in np.flatnonzero((size >= 64) & (few | _repeats(raw, lo, hi))).tolist():
        out[x] = min(out[x], _special(raw[lo[x] : hi[x]], bool(few[x])), key=len)
    return out


def _encode(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: int) -> list[bytes]:
    """Like encode_frames(), with one of the fixed prefix codes."""
    code, width, head, head_bits = _fixed(kind)
    n = len(lo)
    size = hi - lo
    rows = np.maximum(1, -(-size // ROW))
    pad = rows * ROW - size
    lens = size + (pad > 0) + (pad > 1)  # symbols: bytes, a literal 255, a run of those
    stop = np.cumsum(lens)
    begin = stop - lens
    total = int(stop[-1]) if n else 0
    symbol = np.zeros(total, np.int64)
    doc = np.repeat(np.arange(n), lens)
    inside = np.arange(total) - begin[doc]
    of = inside < size[doc]
    symbol[of] = raw[(lo[doc] + inside)[of]]
    symbol[(begin + size)[pad > 0]] = 255
    value, bits = code[symbol], width[symbol]
    for k in np.flatnonzero(pad > 1).tolist():
        s, extra, more = webp._prefix(int(pad[k]) - 1)
        at = stop[k] - 1
        value[at] = int(code[256 + s]) | extra << int(width[256 + s])
        bits[at] = width[256 + s] + more
    ends = np.cumsum(bits)
    first = ends - bits
    used = head_bits + (np.r_[0, ends][stop] - np.r_[0, ends][begin])
    words = -(-used // 32)
    base = np.cumsum(words) - words
    at = 32 * base[doc] + head_bits + first - np.r_[0, ends][begin][doc]
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    wide = value << shift
    m = int(words.sum()) + 1
    out = np.bincount(word, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=m)
    out += np.bincount(word + 1, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=m + 1)[:m]
    for t in range(len(head)):
        np.add.at(out, base + t, float(head[t]))
    data = out.astype(np.uint32).tobytes()
    made = []
    for k in range(n):
        a = 4 * int(base[k])
        made.append(webp.wrap(b"\x2f" + struct.pack("<I", ROW - 1 | int(rows[k]) - 1 << 14) + data[a : a + (int(used[k]) + 7) // 8]))
    return made


class _Shared:
    """What images with one header share: their prefix codes and a table of the next symbols."""

    WINDOW = 15

    def __init__(self, bits: webp.Bits):
        self.codes = None
        if bits.read(1) or bits.read(1) or bits.read(1):
            return
        codes = [webp.read_code(bits, n) for n in (280, 256, 256, 256, 40)]
        self.end = bits.at
        if any(c.single is None for c in codes[1:4]) or codes[0].single is not None:
            return
        self.codes = codes
        v = np.arange(1 << self.WINDOW)
        used, count, packed, live = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros((len(v), 4), np.uint8), np.ones(len(v), bool)
        green = codes[0]
        for k in range(4):
            w = (v >> used) & ((1 << green.most) - 1)
            s, b = green.symbol[w], green.bits[w]
            live &= (s < 256) & (used + b <= self.WINDOW)
            packed[live, k] = s[live]
            used += np.where(live, b, 0)
            count += live
        self.used_list = used.tolist()
        self.some = [x[:c].tobytes() for x, c in zip(packed, count.tolist(), strict=True)]
        # all in one table: count, bits, symbols
        self.entry = (count.astype(np.uint64) << np.uint64(40)) | (used.astype(np.uint64) << np.uint64(32)) | packed.view("<u4")[:, 0].astype(np.uint64)


@lru_cache(1)
def _known() -> list[tuple[bytes, int, _Shared]]:
    """Header, its end in bits, and tables of each fixed prefix code."""
    out = []
    for k in range(KINDS):
        p = webp.stream(_encode(np.zeros(1, np.uint8), np.array([0]), np.array([1]), k)[0])[0]
        s = _Shared(webp.Bits(p, 40))
        out.append((p[5 : s.end >> 3], s.end, s))
    return out


def decode_many(files: list[bytes]) -> list[bytes]:
    """The green samples of every file's image.

    The red, blue and alpha samples must be the same in all pixels of an image.
    """
    out: list[bytes | None] = [None] * len(files)
    groups: dict[bytes, list[int]] = {}
    shared = _known()
    payloads = [webp.stream(f)[0] for f in files]
    for k, p in enumerate(payloads):
        hit = next((t for t in shared if p[5 : 5 + len(t[0])] == t[0]), None)
        if hit is None:
            out[k] = _plain(files[k])
        else:
            groups.setdefault(hit[0], []).append(k)
    for head, own in groups.items():
        end, s = next((e, x) for h, e, x in shared if h == head)
        same = [k for k in own if _tail(payloads[k], end) == _tail(payloads[own[0]], end)]
        for k in {*own} - {*same}:
            out[k] = _plain(files[k])
        for k, x in zip(same, _in_step([payloads[k] for k in same], end, s), strict=True):
            out[k] = x
    return out  # type: ignore[return-value]


def _tail(p: bytes, end: int) -> int:
    return p[end >> 3] & ((1 << (end & 7)) - 1) if end & 7 else 0


def _plain(file: bytes) -> bytes:
    p = webp.decode(file)
    if len(p.ravel()) and (p.ravel()[1:] & np.uint32(0xFFFF00FF) != p.ravel()[0] & np.uint32(0xFFFF00FF)).any():
        raise ValueError("an image of several channels")
    return (p >> 8 & 255).astype(np.uint8).tobytes()


def _in_step(payloads: list[bytes], start: int, s: _Shared) -> list[bytes]:
    n = len(payloads)
    sizes = [webp.size_of(p) for p in payloads]
    total = np.array([w * h for w, h in sizes])
    lens = np.array([len(p) + (-len(p) % 4) + 8 for p in payloads])
    base = np.cumsum(lens) - lens
    words = np.frombuffer(b"".join(p + b"\0" * (int(m) - len(p)) for p, m in zip(payloads, lens, strict=True)) + b"\0" * 16, "<u4").astype(np.uint64)
    wide = words[:-1] | (words[1:] << np.uint64(32))
    last_bit = (base + lens) * 8 - 33
    room = total + 8
    begin = np.cumsum(room) - room
    pixels = np.zeros(int(room.sum()) + 8, np.uint8)
    at, to = base * 8 + start, begin.copy()
    end = begin + total
    ids = np.argsort(-total, kind="stable")
    mask = np.uint64((1 << s.WINDOW) - 1)
    a, t, e, z = at[ids], to[ids], end[ids], last_bit[ids]
    step = 0
    while len(ids):
        v = s.entry[(wide[a >> 5] >> (a & 31).astype(np.uint64)) & mask]
        px = v.astype(np.uint32)
        pixels[t] = px & 255
        pixels[t + 1] = (px >> 8) & 255
        pixels[t + 2] = (px >> 16) & 255
        pixels[t + 3] = px >> 24
        high = (v >> np.uint64(32)).astype(np.int64)
        a = np.minimum(a + (high & 255), z)
        t = np.minimum(t + (high >> 8), e)
        step += 1
        if step % 16 == 0:
            going = (t < e) & (high >> 8 > 0)
            if not going.all():
                at[ids], to[ids] = a, t
                ids, a, t, e, z = ids[going], a[going], t[going], e[going], z[going]
            if len(ids) < FEW:
                break
    at[ids], to[ids] = a, t
    for k in ids.tolist():
        at[k], to[k] = _alone(wide, int(at[k]), int(last_bit[k]), s, pixels, int(to[k]), int(end[k]))
    for k in np.flatnonzero(to < end).tolist():
        _rest(payloads[k], int(at[k] - base[k] * 8), s, pixels, int(begin[k]), int(to[k]), int(end[k]), sizes[k][0])
    return [pixels[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _alone(wide: np.ndarray, at: int, last: int, s: _Shared, pixels: np.ndarray, to: int, end: int) -> tuple[int, int]:
    """Like the common pace, for one image: up to its end or the first symbol that isn't a literal."""
    first = at >> 5
    w = wide[first : (last >> 5) + 1].tolist()
    at, last = at - (first << 5), last - (first << 5)
    mask = (1 << s.WINDOW) - 1
    used, some = s.used_list, s.some
    parts: list[bytes] = []
    add = parts.append
    while at < last:
        v = (w[at >> 5] >> (at & 31)) & mask
        n = used[v]
        if not n:
            break
        add(some[v])
        at += n
    got = b"".join(parts)[: end - to]
    pixels[to : to + len(got)] = np.frombuffer(got, np.uint8)
    return at + (first << 5), to + len(got)


def _rest(payload: bytes, at: int, s: _Shared, pixels: np.ndarray, begin: int, to: int, end: int, width: int) -> None:
    """Reads symbol by symbol from where the common pace stopped."""
    bits = webp.Bits(payload, at)
    green, far = s.codes[0], s.codes[4]
    while to < end:
        x = green.read(bits)
        if x < 256:
            pixels[to] = x
            to += 1
            continue
        n = webp._extra(bits, x - 256)
        d = webp._distance(webp._extra(bits, far.read(bits)), width)
        if to - d < begin or to + n > end:
            raise ValueError("a back-reference leaves the image")
        if d == 1:
            pixels[to : to + n] = pixels[to - 1]
        else:
            for k in range(to, to + n):
                pixels[k] = pixels[k - d]
        to += n
    if bits.at > 8 * len(payload):
        raise ValueError("the data end early")


def encode_payloads(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """The stored form of every range: one or more files."""
    from .common import runs

    out: list[bytes] = []
    for i, j in runs(lo, hi, _SLICE):
        if j - i == 1 and hi[i] - lo[i] > FRAME:
            cut = np.arange(lo[i], hi[i], FRAME)
            out.append(b"".join(f for a in cut for f in encode_frames(raw, np.array([a]), np.array([min(a + FRAME, hi[i])]))))
        else:
            for k in range(i, j, 4096):
                out += encode_frames(raw, lo[k : min(k + 4096, j)], hi[k : min(k + 4096, j)])
    return out


def decode_payloads(stored: list[bytes]) -> list[bytes]:
    files, own = [], []
    for k, data in enumerate(stored):
        while data:
            end = webp.stream(data)[1]
            files.append(data[:end])
            own.append(k)
            data = data[end:]
    got: list[list[bytes]] = [[] for _ in stored]
    for k, x in zip(own, decode_many(files), strict=True):
        got[k].append(x)
    return [x[0] if len(x) == 1 else b"".join(x) for x in got]


def store(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """df with every whole text (null: empty) as WebP; the pixel array's bytes end in 255s up to full rows."""

    @F.arrow_udf("binary")
    def write(x: pa.Array) -> pa.Array:
        return pa.array(encode_payloads(*as_text(x)), pa.binary())

    return df.withColumn(to, write(F.coalesce(F.col(text), F.lit(""))))


def pixels(df: DataFrame, media: str = "media", to: str = "pixels") -> DataFrame:
    """df with the samples of every stored form; null where it is null."""

    @F.arrow_udf("binary")
    def read(x: pa.Array) -> pa.Array:
        some = [v for v in x.to_pylist() if v is not None]
        got = iter(decode_payloads(some))
        return pa.array([None if v is None else next(got) for v in x.to_pylist()], pa.binary())

    return df.withColumn(to, read(media))


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with digests of its payload as read back, of the stored form, and its features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            media = batch.column(2)
            for i in range(0, len(media), 4096):
                stored = media.slice(i, 4096).to_pylist()
                got = decode_payloads(stored)
                n = batch.column(1).slice(i, 4096)
                feature = []
                for p in got:
                    x = np.frombuffer(p, np.uint8)
                    c = np.bincount(x, minlength=256)
                    share = c[c > 0] / len(x)
                    feature.append(f"rows={len(x) // ROW};mean={x.mean():.6f};entropy={-(share * np.log2(share)).sum():.6f};colours={int((c > 0).sum())}")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 4096), n, pa.array([len(p) for p in got], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in got]), pa.array([zlib.crc32(p[-32:]) for p in got], pa.int64()), pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array(feature)],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kept = store(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).select("doc_id", "n_bytes", "media")
    return kept.mapInArrow(digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
