"""Lossless WebP: a decoder of the whole format, and an encoder.

decode() reads prefix codes, back-references, colour caches and meta prefix images and inverts the
predictor, cross-colour, subtract-green and palette transforms.  decode_many() reads many images in
step where they share their prefix codes and hold a single channel; whatever else an image holds, the
scalar decoder reads.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_SIDE = 1 << 14


def _near() -> list[tuple[int, int]]:
    """The 120 short distances (x, y), in the order of their codes: by length, then as the format ranks ties."""
    text = (
        "01 10 11 -11 02 20 12 -12 21 -21 22 -22 03 30 13 -13 31 -31 23 -23 32 -32 04 40 14 -14 41 -41 33 -33 24 -24 42 -42 05 34 -34 43 -43 50 "
        "15 -15 51 -51 25 -25 52 -52 44 -44 35 -35 53 -53 06 60 16 -16 61 -61 26 -26 62 -62 45 -45 54 -54 36 -36 63 -63 07 70 17 -17 55 -55 71 -71 "
        "46 -46 64 -64 27 -27 72 -72 37 -37 73 -73 56 -56 65 -65 80 47 -47 74 -74 81 82 66 -66 83 57 -57 75 -75 84 67 -67 76 -76 85 77 -77 86 87"
    )
    return [(int(s[:-1]), int(s[-1])) for s in text.split()]


NEAR = _near()


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + (n + 14) // 8 + 1], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the data end early")
        return v


class Writer:
    def __init__(self):
        self.value, self.n, self.out = 0, 0, bytearray()

    def write(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.n -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value & 255]) if self.n else b"")


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """symbol -> (code as it lies in the stream, number of bits); a single symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0]: (0, 0)}
    code, last, out = 0, 0, {}
    for n, s in sorted((lengths[s], s) for s in used):
        code <<= n - last
        last = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    if used and code != 1 << last:
        raise ValueError("a prefix code isn't complete")
    return out


class Code:
    """A prefix code for reading: 15-bit windows -> (symbol, bits)."""

    def __init__(self, lengths):
        self.lengths = tuple(lengths)
        codes = canonical(self.lengths)
        if not codes:
            codes = {0: (0, 0)}
        self.most = max(n for _, n in codes.values())
        self.symbol, self.bits = np.zeros(1 << self.most, np.int32), np.zeros(1 << self.most, np.int8)
        for s, (c, n) in codes.items():
            self.symbol[c :: 1 << n] = s
            self.bits[c :: 1 << n] = n
        self.single = next(iter(codes)) if len(codes) == 1 else None
        self._s, self._b = self.symbol.tolist(), self.bits.tolist()

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        v = bits.peek(self.most)
        bits.at += self._b[v]
        return self._s[v]


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    small = [0] * 19
    for k in range(4 + bits.read(4)):
        small[ORDER[k]] = bits.read(3)
    code = Code(small)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            if s == 16:
                lengths[at : at + n] = [before] * n
            at += n
    return Code(lengths)


def _extra(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: ARGB pixels in a row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, size, groups = None, 0, 1
    if main and bits.read(1):
        size = bits.read(3) + 2
        across = -(-width >> size)
        meta = (_image(bits, across, -(-height >> size), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    alphabet = 280 + ((1 << cache_bits) if cache_bits else 0)
    codes = [[read_code(bits, n) for n in (alphabet, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    green, red, blue, alpha, far = codes[0]
    at = 0
    while at < total:
        if meta is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[meta[(y >> size) * across + (x >> size)]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            new = at + 1
        elif s < 280:
            n = _extra(bits, s - 256)
            d = _distance(_extra(bits, far.read(bits)), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            new = at + n
        else:
            out[at] = cache[s - 280]
            new = at + 1
        if cache is not None:
            for p in out[at:new]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at = new
        if bits.at > 8 * len(bits.data) + 64:
            raise ValueError("the data end early")
    return np.array(out, np.uint32)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def predict(mode: int, left, top, corner, right) -> tuple[int, ...]:
    """The predicted pixel, as (a, r, g, b), from its neighbours as such."""
    half = lambda x, y: tuple((a + b) >> 1 for a, b in zip(x, y, strict=True))
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        a = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        b = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if a < b else top
    if mode == 12:
        return tuple(clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True))
    if mode == 13:
        return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner, strict=True))
    return 255, 0, 0, 0


def _predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, size: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) the predictions."""
    src = [_parts(p) for p in pixels.tolist()]
    done = [(0, 0, 0, 0)] * len(src) if sign == 1 else src
    out = [0] * len(src)
    across = -(-width >> size)
    for y in range(height):
        for x in range(width):
            k = y * width + x
            if y == 0:
                p = (255, 0, 0, 0) if x == 0 else done[k - 1]
            elif x == 0:
                p = done[k - width]
            else:
                mode = (int(modes[(y >> size) * across + (x >> size)]) >> 8) & 15
                p = predict(mode, done[k - 1], done[k - width], done[k - width - 1], done[k - width + 1])
            q = tuple((a + sign * b) & 255 for a, b in zip(src[k], p, strict=True))
            if sign == 1:
                done[k] = q
            out[k] = q[0] << 24 | q[1] << 16 | q[2] << 8 | q[3]
    return np.array(out, np.uint32)


def _spread(sub: np.ndarray, width: int, height: int, size: int) -> np.ndarray:
    across = -(-width >> size)
    return sub.reshape(-1, across)[np.arange(height)[:, None] >> size, np.arange(width)[None, :] >> size].ravel()


def _signed(x) -> np.ndarray:
    return (np.asarray(x) & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def _cross_colour(pixels: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    red, green, blue = pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255
    of_red, of_blue, mixed = _signed(elements), _signed(elements >> 8), _signed(elements >> 16)
    g = _signed(green)
    new_red = (red.astype(np.int32) + sign * ((of_red * g) >> 5)) & 255
    tint = _signed(new_red if sign == 1 else red)
    new_blue = (blue.astype(np.int32) + sign * (((of_blue * g) >> 5) + ((mixed * tint) >> 5))) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (new_red.astype(np.uint32) << 16) | new_blue.astype(np.uint32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    g = (pixels >> 8 & 255).astype(np.int32)
    red, blue = ((pixels >> 16 & 255).astype(np.int32) + sign * g) & 255, ((pixels & 255).astype(np.int32) + sign * g) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (red.astype(np.uint32) << 16) | blue.astype(np.uint32)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def stream(data: bytes) -> tuple[bytes, int]:
    """The VP8L payload of a file and where the file ends."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("this is no WebP file")
    end, at = 8 + struct.unpack("<I", data[4:8])[0], 12
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return data[at + 8 : at + 8 + n], end
        at += 8 + n + (n & 1)
    raise ValueError("this file holds no lossless image")


def size_of(payload: bytes) -> tuple[int, int]:
    if payload[:1] != b"\x2f" or payload[4] >> 5:
        raise ValueError("this is no lossless image")
    v = struct.unpack("<I", payload[1:5])[0]
    return (v & 16383) + 1, (v >> 14 & 16383) + 1


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of the first image of a file."""
    payload, _ = stream(data)
    width, height = size_of(payload)
    bits = Bits(payload, 40)
    across, undo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            sub = _image(bits, -(-across >> size), -(-height >> size), False)
            undo.append((kind, across, size, sub))
        elif kind == 2:
            undo.append((2, across, 0, None))
        else:
            n = bits.read(8) + 1
            table = _image(bits, n, 1, False)
            table = np.cumsum(np.stack([table >> 24, table >> 16 & 255, table >> 8 & 255, table & 255]), axis=1) & 255
            undo.append((3, across, _packing(n), (table[0] << 24 | table[1] << 16 | table[2] << 8 | table[3]).astype(np.uint32)))
            across = -(-across >> _packing(n))
    pixels = _image(bits, across, height, True)
    for kind, w, size, sub in reversed(undo):
        if kind == 0:
            pixels = _predictor(pixels, w, height, sub, size, 1)
        elif kind == 1:
            pixels = _cross_colour(pixels, _spread(sub, w, height, size), 1)
        elif kind == 2:
            pixels = _green(pixels, 1)
        else:
            per, narrow = 8 >> size, -(-w >> size)
            x = np.arange(w)
            packed = (pixels.reshape(height, narrow) >> 8 & 255)[:, x >> size]
            index = packed >> (per * (x & ((1 << size) - 1))) & ((1 << per) - 1)
            pixels = np.where(index < len(sub), sub[np.minimum(index, len(sub) - 1)], 0).astype(np.uint32).ravel()
    return pixels.reshape(height, width)


def huffman(weights, most: int = 15) -> list[int]:
    """Code lengths of at most ``most`` bits; weights are flattened until they fit."""
    used = [s for s, w in enumerate(weights) if w]
    if len(used) < 2:
        return [int(s in used) for s in range(len(weights))]
    w = list(weights)
    while True:
        heap = [(w[s], s, (s,)) for s in used]
        heapq.heapify(heap)
        lengths = [0] * len(w)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= most:
            return lengths
        w = [x and x // 2 + 1 for x in w]


def write_code(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        wide = used[0] > 1
        out.write(int(wide), 1)
        out.write(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.write(used[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []
    k = 0
    while k < len(lengths):
        n = 1
        while k + n < len(lengths) and lengths[k + n] == lengths[k]:
            n += 1
        run = n
        if lengths[k] == 0:
            while run:
                if run >= 11:
                    t = min(run, 138)
                    tokens.append((18, t - 11, 7))
                elif run >= 3:
                    t = run
                    tokens.append((17, t - 3, 3))
                else:
                    t = 1
                    tokens.append((0, 0, 0))
                run -= t
        else:
            tokens.append((lengths[k], 0, 0))
            run -= 1
            while run:
                t = min(run, 6) if run >= 3 else 1
                tokens.append((16, t - 3, 2) if t >= 3 else (lengths[k], 0, 0))
                run -= t
        k += n
    weights = [0] * 19
    for t, *_ in tokens:
        weights[t] += 1
    small = huffman(weights, 7)
    if sum(1 for n in small if n) == 1:  # so that each token takes a bit
        small[0 if not small[0] else 1] = 1
    codes = canonical(small)
    out.write(0, 1)
    n = max(4, max(i for i, s in enumerate(ORDER) if small[s]) + 1)
    out.write(n - 4, 4)
    for s in ORDER[:n]:
        out.write(small[s], 3)
    out.write(0, 1)
    for t, extra, bits in tokens:
        out.write(*codes[t])
        out.write(extra, bits)


def _prefix(v: int) -> tuple[int, int, int]:
    """A length or distance code as (symbol, extra value, its bits)."""
    if v <= 4:
        return v - 1, 0, 0
    n = (v - 1).bit_length() - 2
    low = (v - 1) >> n
    return 2 * n + low, (v - 1) - (low << n), n


def _write_image(out: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, match: bool = True) -> None:
    p = pixels.tolist()
    cache = [0] * (1 << cache_bits) if cache_bits else None
    tokens: list[tuple] = []
    seen: dict[tuple, int] = {}
    short = {}
    for c in range(120, 0, -1):
        short[_distance(c, width)] = c
    k = 0

    def keep(q: int) -> None:
        if cache is not None:
            cache[(0x1E35A7BD * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q

    while k < len(p):
        at, n = seen.get(tuple(p[k : k + 3])) if match else None, 0
        if at is not None:
            while k + n < len(p) and n < 4096 and p[at + n] == p[k + n]:
                n += 1
        if n >= 3:
            d = k - at
            tokens.append((256 + (s := _prefix(n))[0], s[1:], _prefix(short.get(d, d + 120))))
        else:
            n, h = 1, (0x1E35A7BD * p[k] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append((280 + h,) if cache is not None and cache[h] == p[k] else (p[k] >> 8 & 255, p[k]))
        for j in range(k, k + n):
            seen[tuple(p[j : j + 3])] = j
            keep(p[j])
        k += n
    weights = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    for t in tokens:
        weights[0][t[0]] += 1
        if t[0] < 256:
            for c, shift in ((1, 16), (2, 0), (3, 24)):
                weights[c][t[1] >> shift & 255] += 1
        elif t[0] < 280:
            weights[4][t[2][0]] += 1
    out.write(int(bool(cache_bits)), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if main:
        out.write(0, 1)
    codes = []
    for w in weights:
        lengths = huffman(w)
        write_code(out, lengths)
        codes.append(canonical(lengths))
    for t in tokens:
        out.write(*codes[0][t[0]])
        if t[0] < 256:
            for c, shift in ((1, 16), (2, 0), (3, 24)):
                out.write(*codes[c][t[1] >> shift & 255])
        elif t[0] < 280:
            out.write(*t[1])
            out.write(*codes[4][t[2][0]])
            out.write(*t[2][1:])


def wrap(payload: bytes) -> bytes:
    pad = len(payload) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(payload) + pad) + b"WEBPVP8L" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def encode(argb: np.ndarray, predictor: int | None = None, modes=None, cross: tuple[int, int, int] | None = None, subtract: bool = False, palette: bool = False, cache_bits: int = 0, block: int = 3) -> bytes:
    """A file with the transforms asked for: predictor (a mode, or a mode for each block), cross-colour, subtract-green, palette."""
    height, width = argb.shape
    if not 0 < min(argb.shape) <= max(argb.shape) <= MAX_SIDE:
        raise ValueError("an image's sides are 1 to 16384 pixels")
    pixels, across = argb.astype(np.uint32).ravel(), width
    out = Writer()
    out.write(0x2F, 8)
    out.write(width - 1 | height - 1 << 14 | int((pixels >> 24 != 255).any()) << 28, 32)
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        out.write(0b111, 3)
        out.write(len(colours) - 1, 8)
        part = np.stack([colours >> s & 255 for s in (24, 16, 8, 0)]).astype(np.int64)
        part[:, 1:] -= part[:, :-1].copy()
        part &= 255
        _write_image(out, part[0] << 24 | part[1] << 16 | part[2] << 8 | part[3], len(colours), False)
        size = _packing(len(colours))
        across = -(-width >> size)
        wide = np.zeros((height, across << size), np.uint32)
        wide[:, :width] = index.reshape(height, width)
        packed = sum(wide[:, k :: 1 << size] << ((8 >> size) * k) for k in range(1 << size))
        pixels = (np.uint32(0xFF000000) | packed.astype(np.uint32) << 8).ravel()
    if subtract:
        out.write(0b101, 3)
        pixels = _green(pixels, -1)
    if cross:
        out.write(0b011, 3)
        out.write(block - 2, 3)
        n = (-(-across >> block)) * (-(-height >> block))
        sub = np.full(n, 0xFF000000 | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | cross[0] & 255, np.uint32)
        _write_image(out, sub, -(-across >> block), False)
        pixels = _cross_colour(pixels, _spread(sub, across, height, block), -1)
    if predictor is not None or modes is not None:
        out.write(0b001, 3)
        out.write(block - 2, 3)
        n = (-(-across >> block)) * (-(-height >> block))
        sub = np.array([0xFF000000 | m << 8 for m in (modes or [predictor] * n)], np.uint32)
        _write_image(out, sub, -(-across >> block), False)
        pixels = _predictor(pixels, across, height, sub, block, -1)
    out.write(0, 1)
    _write_image(out, pixels, across, True, cache_bits)
    return wrap(out.done())
